"""Votes on readings: weighted sums, majorities with a fixed tie rule, shares, context, joins.

Weights are summed as decimals, so that no result depends on the order of rows. Everything is a grouping by
(key, value) first, which Spark combines before the shuffle, so a hot key only meets its few distinct values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHT = "decimal(18,3)"


def trust(kind: Column, weights: Mapping[str, float]) -> Column:
    """Weight of a row by its kind; kinds not listed, and NULL, weigh nothing."""
    out = F.lit(0)
    for k, w in weights.items():
        out = F.when(kind == k, F.lit(w)).otherwise(out)
    return out.cast(WEIGHT)


def weighted(rows: DataFrame, key: Sequence[str], value: str, weight: Column, order: str) -> DataFrame:
    """(key..., value, w, first): summed weight of each value and the least ``order`` at which it stood. Rows without
    weight, value or key don't vote."""
    present = F.col(value).isNotNull() & (weight > 0)
    for k in key:
        present = present & F.col(k).isNotNull()
    return rows.where(present).groupBy(*key, value).agg(F.sum(weight.cast(WEIGHT)).cast(WEIGHT).alias("w"), F.min(order).alias("first"))


def majority(votes: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key..., value, w, total): the value of most weight; of equal ones the one seen first, then the lesser."""
    rank = F.struct((-F.col("w")).alias("w"), F.col("first"), F.col(value))
    got = votes.groupBy(*key).agg(F.min(rank).alias("best"), F.sum("w").cast(WEIGHT).alias("total"))
    return got.select(*key, F.col(f"best.{value}").alias(value), (-F.col("best.w")).cast(WEIGHT).alias("w"), "total")


def top(votes: DataFrame, key: Sequence[str], value: str, n: int = 3) -> DataFrame:
    """(key..., values): the n heaviest values, each with its weight, as an array in that order."""
    by = Window.partitionBy(*key).orderBy(F.desc("w"), "first", value)
    few = votes.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
    packed = few.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank", value, "w"))).alias("x"))
    return packed.select(*key, F.transform("x", lambda e: F.struct(e[value].alias(value), e["w"].alias("w"))).alias("values"))


def dominant(votes: DataFrame, key: Sequence[str], value: str, share: float = 0.6, least: float = 5, most: bool = False) -> DataFrame:
    """(key..., value, w, total): majorities of at least ``share`` of the weight and at least ``least`` in all, or,
    with ``most``, of the value itself."""
    got = majority(votes, key, value)
    enough = F.col("w") if most else F.col("total")
    return got.where((F.col("w") >= F.col("total") * F.lit(share).cast("decimal(3,2)")) & (enough >= least))


def context_overrides(pairs: DataFrame, words: DataFrame, key: Sequence[str], word: str, value: str, least: int = 2, share: float = 0.75) -> DataFrame:
    """(key..., value, n, total): readings next to a neighbour that differ from the word's majority, seen at least
    ``least`` times and in ``share`` of the cases. ``pairs``: votes by key (which holds ``word``); ``words``: the
    word's majorities (word, value)."""
    got = majority(pairs, key, value).join(words.select(word, F.col(value).alias("_usual")), word)
    return got.where((F.col(value) != F.col("_usual")) & (F.col("w") >= least) & (F.col("w") >= F.col("total") * F.lit(share).cast("decimal(3,2)"))).drop("_usual")


def suppressed(own: DataFrame, absorbed: DataFrame, key: str, value: str) -> DataFrame:
    """``own`` (key, value, n) with NULL for a word that is written into its neighbour (absorbed: key, n) more often
    than it stands alone."""
    lost = absorbed.select(key, F.col("n").alias("_n"))
    return own.join(lost, key, "left").withColumn(value, F.when(F.coalesce("_n", F.lit(0)) <= F.col("n"), F.col(value))).drop("_n")


def capitals(words: DataFrame, key: str, value: str, inside: str) -> DataFrame:
    """(key, capital): whether a word is written with a capital more often than not, counting only places ``inside``
    a line."""
    up = F.substring(value, 1, 1)
    capital = (up != F.lower(up)).cast("int")
    return words.where(F.col(inside) & (F.col(value) != "")).groupBy(key).agg((F.sum(capital * 2 - 1) > 0).alias("capital"))


def glue_rates(joins: DataFrame, endings: Sequence[str], word: str, joiner: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., ending, rate): how often an ending is written together with the word before it, to three digits; 0 for
    an ending never seen."""
    spark = joins.sparkSession
    wanted = spark.createDataFrame([(e,) for e in endings], f"{word} string")
    if by:
        wanted = wanted.crossJoin(joins.select(*by).distinct())
    seen = joins.where(F.col(word).isin(*endings)).groupBy(*by, word).agg((F.count_if(F.col(joiner) == "+") / F.count("*")).alias("rate"))
    return wanted.join(seen, [*by, word], "left").withColumn("rate", F.round(F.coalesce("rate", F.lit(0.0)), 3))


def pair_tallies(pairs: DataFrame, first: str, second: str, joined: str) -> DataFrame:
    """(first, second, joined, apart) of neighbouring words, only for first words that are ever joined."""
    got = pairs.groupBy(first, second).agg(F.count_if(F.col(joined)).alias("joined"), F.count_if(~F.col(joined)).alias("apart"))
    return got.join(got.where("joined > 0").select(first).distinct(), first, "left_semi")


def confidence(votes: DataFrame, candidates: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key..., candidate, confidence): of ``candidates`` (key..., pos, candidate, value) the one whose value has most
    weight, the earlier of equal ones, and its share of all weight of the key, 0 where none matches."""
    total = votes.groupBy(*key).agg(F.sum("w").alias("total"))
    scored = candidates.join(votes.select(*key, value, "w"), [*key, value], "left").withColumn("w", F.coalesce("w", F.lit(0).cast(WEIGHT)))
    best = scored.groupBy(*key).agg(F.min(F.struct((-F.col("w")).alias("w"), "pos", "candidate")).alias("b"))
    return best.join(total, list(key), "left").select(*key, "b.candidate", F.coalesce(F.round((-F.col("b.w")).cast("double") / F.col("total").cast("double"), 6), F.lit(0.0)).alias("confidence"))


def log_shares(rows: DataFrame, counts: DataFrame, key: str, value: str, by: Sequence[str]) -> DataFrame:
    """(by..., score): sum of ln((hit + 0.5) / (total + 1)) over the words of a reading that the lexicon ``counts``
    (key, value, n) knows; 0 where it knows none."""
    total = counts.groupBy(key).agg(F.sum("n").alias("total"))
    hit = counts.groupBy(key, value).agg(F.sum("n").alias("hit"))
    got = rows.join(total, key, "left").join(hit, [key, value], "left")
    share = F.when(F.col("total").isNotNull(), F.log((F.coalesce("hit", F.lit(0)) + 0.5) / (F.col("total") + 1.0)))
    return got.groupBy(*by).agg(F.round(F.coalesce(F.sum(share), F.lit(0.0)), 6).alias("score"))
