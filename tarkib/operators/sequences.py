"""Order-dependent cutting of lines: chunks, couplets, groups between separators, first occurrences."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_occurrence(rows: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """Each value once, with the least ``order`` at which it stands: a grouping that combines before the shuffle."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(F.struct(*order)).alias("o")).select(value, "o.*")


def fixed_chunks(rows: DataFrame, group: Sequence[str], order: Sequence[str], size: int = 8) -> DataFrame:
    """``rows`` with ``chunk`` from 0; rows of a last, shorter chunk are left out."""
    by = Window.partitionBy(*group)
    n = rows.withColumn("_n", F.row_number().over(by.orderBy(*order)) - 1).withColumn("_all", F.count("*").over(by))
    return n.withColumn("chunk", F.floor(F.col("_n") / size).cast("int")).where((F.col("chunk") + 1) * size <= F.col("_all")).drop("_n", "_all")


def couplets(line_no: Column) -> Column:
    return F.floor(line_no / 2).cast("int")


def between(rows: DataFrame, group: Sequence[str], order: Sequence[str], separator: Column) -> DataFrame:
    """Rows that are no separator, with ``part``: how many separators of the group come before."""
    by = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_s", separator).withColumn("part", F.sum(F.col("_s").cast("int")).over(by)).where(~F.col("_s")).drop("_s")


def stanza_chunks(lines: list[str], full: int = 16) -> list[list[str]]:
    """Chunks of a poem's lines: cut at a blank line once ``full`` - 1 lines are gathered, what is left in slices of
    ``full``."""
    out: list[list[str]] = []
    now: list[str] = []
    for line in [*lines, ""]:
        if line:
            now.append(line)
        elif len(now) >= full - 1:
            out.append(now)
            now = []
    return out + [now[i : i + full] for i in range(0, len(now), full)]


_CHUNK = [T.StructField("chunk", T.IntegerType()), T.StructField("lines", T.ArrayType(T.StringType()))]


def poem_chunks(lines: DataFrame, poem: str, order: str, line: str, full: int = 16) -> DataFrame:
    """(poem, chunk, lines): ``stanza_chunks`` of each poem; a line already seen, in any poem, is left out, blank ones
    stay as breaks. The poem is the unit of work."""
    text = lines.where(F.col(line) != "")
    firsts = text.groupBy(line).agg(F.min(F.struct(poem, order)).alias("f")).select(line, F.col(f"f.{poem}").alias(poem), F.col(f"f.{order}").alias(order))
    kept = firsts.select(poem, order, line).unionByName(lines.where(F.col(line) == "").select(poem, order, line))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        chunks = stanza_chunks(list(df.sort_values(order)[line]), full)
        got = pd.DataFrame({"chunk": pd.Series(range(len(chunks)), dtype="int32"), "lines": pd.Series(chunks, dtype=object)})
        got.insert(0, poem, df[poem].iloc[0])
        return got

    return kept.groupBy(poem).applyInPandas(run, T.StructType([lines.schema[poem], *_CHUNK]))


def silver_tiers(confidence: Column, hindi: Column, urdu: Column, wiki: Column) -> Column:
    """Tier of a silver pair by who backs it: A, B, W1, W2, or NULL for one to leave out."""
    return F.when(wiki, F.when(confidence >= 0.5, "W1").otherwise("W2")).when((hindi >= 1) & (urdu >= 1) & (confidence >= 0.7), "A").when((hindi >= 1) & (confidence >= 0.5), "B")


def length_buckets(df: DataFrame, length: Column, buckets: int = 64) -> DataFrame:
    """Rows of like length in one partition and in order there: batches for a model need little padding."""
    return df.withColumn("_length", length).repartitionByRange(buckets, "_length").sortWithinPartitions("_length").drop("_length")


def epoch_sample(df: DataFrame, task: str, wanted: dict[str, int], seed: int) -> DataFrame:
    """So many rows of each task, drawn by a seeded hash of the whole row: the same for a seed, whatever the partitions;
    tasks not named come whole. A sampling operator: the limit is what it is for."""
    out = None
    draw = F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns])
    for name, n in wanted.items():
        got = df.where(F.col(task) == name).orderBy(draw).limit(n)
        out = got if out is None else out.unionByName(got)
    rest = df.where(~F.col(task).isin(*wanted) | F.col(task).isNull()) if wanted else df
    return rest if out is None else out.unionByName(rest)


def repeated(df: DataFrame, times: Column) -> DataFrame:
    return df.withColumn("_t", F.explode(F.array_repeat(F.lit(0), times))).drop("_t")
