"""Problem 3: splits that keep related records together.

Method: components over the names of groups and the contents they share, then largest differencing of the components'
sizes into many equal bins, then whole bins to splits by the wanted shares.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, letters_udf
from .graphs import components

BINS = 200
#: Components of one size are numbered in so many parts, so that no task numbers all of them.
PARTS = 1024


def source_name(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def group_names(df: DataFrame, source: str, group: str) -> DataFrame:
    """(src, grp, stored, key): each stored source and group name once, the source in its one form and the group's letters
    and digits; names without any are left out."""
    names = df.select(F.col(f"`{source}`").alias("stored"), F.col(f"`{group}`").alias("grp")).where("grp IS NOT NULL").distinct()
    named = names.withColumn("key", letters_udf("grp")).where("key <> ''")
    return cut(named.select(source_name(F.col("stored")).alias("src"), "grp", "stored", "key"))


def with_component(df: DataFrame, source: str, group: str, ties: Sequence[str], row: Sequence[str]) -> DataFrame:
    """``df`` and a column ``component``. Rows are related if they are of one source and one group, however its name is
    written, or agree in one of the columns ``ties`` (NULL ties nothing), and so on through others. A row without group
    name and ties is related to rows equal in the columns ``row`` only."""
    names = group_names(df, source, group)
    c = {x: F.col(f"`{x}`") for x in (source, group, *ties, *row)}
    own = df.join(names.select(F.col("stored").alias("_s"), F.col("grp").alias("_g"), F.xxhash64(F.lit("group"), F.coalesce("src", F.lit("")), "key").alias("_group")), c[source].eqNullSafe(F.col("_s")) & (c[group] == F.col("_g")), "left").drop("_s", "_g")
    tied = [F.when(c[t].isNotNull(), F.xxhash64(F.lit(t), c[t].cast("string"))) for t in ties]
    alone = F.xxhash64(F.lit("row"), F.to_json(F.struct(*[c[x] for x in row])))
    own = cut(own.withColumn("_node", F.coalesce("_group", *tied, alone)).withColumn("_ties", F.array_compact(F.array(*tied)) if tied else F.array().cast("array<long>")))
    edges = own.select(F.col("_node").alias("u"), F.explode("_ties").alias("v")).where("u <> v").distinct()
    found = components(edges)
    out = own.join(found.select(F.col("node").alias("_node"), "component"), "_node", "left")
    return out.withColumn("component", F.coalesce("component", "_node")).drop("_node", "_ties", "_group")


def differencing(weights: list[int], bins: int) -> list[list[int]]:
    """Indices of ``weights`` in ``bins`` groups of about equal sum: again and again the two partial
    partitions of widest spread are joined, the heaviest bins of one with the lightest of the other."""
    if not weights:
        return [[] for _ in range(bins)]
    tick, heap = itertools.count(), []
    for i, w in enumerate(weights):
        sums = np.zeros(bins, dtype=np.int64)
        sums[0] = w
        heap.append((-int(w), next(tick), sums, [(i,)] + [()] * (bins - 1)))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, sa, ma = heapq.heappop(heap)
        _, _, sb, mb = heapq.heappop(heap)
        s = sa + sb[::-1]
        order = np.argsort(-s, kind="stable")
        joined = [(x, y) if x and y else x or y for x, y in zip(ma, reversed(mb), strict=True)]
        s = s[order]
        heapq.heappush(heap, (-int(s[0] - s[-1]), next(tick), s, [joined[k] for k in order]))
    out = []
    for tree in heap[0][3]:
        flat, stack = [], [tree]
        while stack:
            for x in stack.pop():
                flat.append(x) if isinstance(x, int) else stack.append(x)
        out.append(sorted(flat))
    return out


def binned(sizes: list[tuple[int, int]], bins: int) -> np.ndarray:
    """How many components of each size every bin gets: (sizes, bins). Of each size every bin gets the same whole number,
    which leaves nothing to balance; fewer than ``bins`` of each size are left, and they are differenced."""
    out = np.array([[count // bins] * bins for _, count in sizes], dtype=np.int64).reshape(len(sizes), bins)
    rest = [k for k, (_, count) in enumerate(sizes) for _ in range(count % bins)]
    for b, group in enumerate(differencing([sizes[k][0] for k in rest], bins)):
        for i in group:
            out[rest[i], b] += 1
    return out


def allocate(sums: list[int], shares: dict[str, float]) -> list[str]:
    """A split for each bin, heaviest first, always to the split that lacks most."""
    total, scale = sum(sums), sum(shares.values()) or 1
    lack = {k: total * v / scale for k, v in shares.items()}
    out = [""] * len(sums)
    for i in sorted(range(len(sums)), key=lambda i: (-sums[i], i)):
        best = max(sorted(lack), key=lambda k: lack[k])
        out[i] = best
        lack[best] -= sums[i]
    return out


def numbered(sizes: DataFrame, parts: int = PARTS) -> DataFrame:
    """(component, n, at): the components of each size counted from 0, in ``parts`` parts by hash."""
    placed = sizes.withColumn("part", F.pmod(F.xxhash64("component"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("n", "part").agg(F.count("*").alias("c"))
    before = Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    at = F.row_number().over(Window.partitionBy("n", "part").orderBy("component")) - 1
    return placed.withColumn("k", at).join(offsets, ["n", "part"]).select("component", "n", (F.col("first") + F.col("k")).alias("at"))


def assign(rows: DataFrame, shares: dict[str, float], bins: int = BINS, parts: int = PARTS) -> DataFrame:
    """``rows`` (with ``component``) and a column ``split``; rows of one component always get the same. Every
    row stays, repeated ones too. An empty table stays empty. Shares need not add up to 1.

    The driver sees how many components there are of each size: of n rows at most sqrt(2 n) different sizes."""
    if not shares:
        raise ValueError("no splits wanted")
    spark = rows.sparkSession
    sizes = cut(rows.groupBy("component").agg(F.count("*").alias("n")))
    known = sorted((int(r.n), int(r.c)) for r in sizes.groupBy("n").agg(F.count("*").alias("c")).collect())
    counts = binned(known, bins)
    weights = np.array([n for n, _ in known], dtype=np.int64)
    names = allocate([int(x) for x in weights @ counts] if known else [0] * bins, shares)
    limits = []
    for k, (n, _) in enumerate(known):
        upto = 0
        for name in sorted(set(names)):
            size = int(sum(counts[k, b] for b in range(bins) if names[b] == name))
            if size:
                limits.append((n, upto, upto + size, name))
                upto += size
    quota = spark.createDataFrame(limits, "n long, low long, high long, split string").groupBy("n").agg(F.collect_list(F.struct("low", "high", "split")).alias("q"))
    placed = numbered(sizes, parts).join(quota, "n")
    which = F.filter("q", lambda x: (x["low"] <= F.col("at")) & (F.col("at") < x["high"]))[0]["split"]
    return rows.join(placed.select("component", which.alias("split")), "component")


def same_group_names(df: DataFrame, source: str = "src", group: str = "grp") -> DataFrame:
    """(src, grp_a, grp_b): different stored names of one group: the groups of the components, before ties join them."""
    kinds = group_names(df, source, group).where("src IS NOT NULL").select("src", "key", F.col("grp").alias("grp_a")).distinct()
    many = kinds.groupBy("src", "key").agg(F.min("grp_a").alias("lo"), F.max("grp_a").alias("hi")).where("lo <> hi")
    kinds = kinds.join(many.select("src", "key"), ["src", "key"], "left_semi")
    return kinds.join(kinds.withColumnRenamed("grp_a", "grp_b"), ["src", "key"]).where("grp_a < grp_b").select("src", "grp_a", "grp_b")
