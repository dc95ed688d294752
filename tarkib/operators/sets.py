"""Splits by hash, content ids, rows held out, resuming, priorities and overlays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WIDE = 4294967295


def bucket(key: Column) -> Column:
    """A fixed place of a key between 0 and 1; NULL stays NULL."""
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 8), 16, 10).cast("bigint") / F.lit(_WIDE)


def place(key: Column, of: int = 10) -> Column:
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 8), 16, 10).cast("bigint") % of


def content_id(text: Column) -> Column:
    return F.substring(F.md5(F.encode(text, "UTF-8")), 1, 16)


def split_by_hash(key: Column, shares: Mapping[str, float], rest: str = "train") -> Column:
    """A split by the key's bucket: the shares take their part from 0 upwards in order, the rest is ``rest``, as is
    NULL. Rows with one key are always together, whatever else the table holds."""
    out, upto = F.lit(rest), sum(shares.values())
    for name, share in reversed(list(shares.items())):
        out = F.when(bucket(key) < F.lit(round(upto, 9)), F.lit(name)).otherwise(out)
        upto -= share
    return out


def split_by_place(key: Column, low: int = 3, under: str = "test", over: str = "dev") -> Column:
    return F.when(place(key) < low, under).otherwise(F.when(key.isNotNull(), over))


def without(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't held out anywhere; a NULL key is never held out."""
    return rows.join(held.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet done, once each: what a run that was interrupted takes up again."""
    return without(rows, done, key).dropDuplicates([key])


def by_priority(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Union in which the row of the last table that has a key wins, the greatest of several in it."""
    out = None
    for rank, df in enumerate(tables):
        got = df.select(F.col(key), F.struct(F.lit(rank).alias("rank"), *[F.col(c) for c in df.columns if c != key]).alias("row"))
        out = got if out is None else out.unionByName(got)
    best = out.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("row").alias("row"))
    return best.select(key, "row.*").drop("rank")


def latest(log: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last line of each key in a log of corrections; NULL keys are a key of their own."""
    rest = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return last.select(*key, "row.*")


def overlaid(draft: DataFrame, fixes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A draft with reviewed fixes over it: '-' in the first column drops the word, '.' or '' keeps the draft's value,
    anything else replaces it; words that only the fixes have are added if whole. Two fixes of one word are an error."""
    one = fixes.groupBy(key).agg(*[F.min(c).alias(f"_{c}") for c in columns], F.count("*").alias("_times"))
    one = one.withColumn("_once", F.when(F.col("_times") > 1, F.raise_error(F.concat(F.lit("duplicate fix for "), F.col(key)))).otherwise(F.lit(True)))
    both = draft.join(one, key, "full_outer").where("coalesce(_once, true)")
    both = both.where(F.coalesce(F.col(f"_{columns[0]}"), F.lit(".")) != "-")
    kept = {c: F.when(F.coalesce(F.col(f"_{c}"), F.lit(".")).isin(".", ""), F.col(c)).otherwise(F.col(f"_{c}")) for c in columns}
    out = both.select(key, *[v.alias(c) for c, v in kept.items()])
    return out.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))


def zipped(df: DataFrame, keep: Sequence[str], arrays: Mapping[str, Column]) -> DataFrame:
    """(keep..., pos, names...): arrays side by side, only where they are equally long."""
    names = list(arrays)
    named = df.select(*keep, *[v.alias(f"_a_{n}") for n, v in arrays.items()])
    same = None
    for n in names[1:]:
        c = F.size(f"_a_{n}") == F.size(f"_a_{names[0]}")
        same = c if same is None else same & c
    rows = named.where(same).select(*keep, F.posexplode(F.arrays_zip(*[f"_a_{n}" for n in names])).alias("pos", "z"))
    return rows.select(*keep, "pos", *[F.col(f"z._a_{n}").alias(n) for n in names])
