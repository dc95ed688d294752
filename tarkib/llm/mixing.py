"""Problem 8: mixing sources to target weights.

Method: tokens per source, from them the repetition rates, then each document floor(rate) times and once more
if its seeded hash falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import token_counts


def source_name(c: str):
    return F.lower(F.regexp_replace(F.col(c), r"(?U)\s+", ""))


def _sized(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, h, source, tokens) of the documents of a wanted source."""
    wanted = targets.select(source_name("source").alias("source")).where("source IS NOT NULL").distinct()
    named = docs.select("doc_id", "text", source_name("source").alias("source")).join(wanted, "source", "left_semi")
    sized = token_counts(named, "doc_id", "text")
    named = named.select("doc_id", F.xxhash64("text").alias("h"), "source").groupBy("doc_id", "h").agg(F.min("source").alias("source"))
    return cut(named.join(sized, (named.doc_id.eqNullSafe(sized.doc_id)) & (named.h == sized.h)).select(named.doc_id, named.h, "source", "tokens"))


def rates(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, wanted, rate): how often each source's documents are used so that
    the mixture has ``total`` tokens, by default as many as all wanted sources have together, in the wanted shares. A
    source that can't give its part even with every document used ``max_repeats`` times is used that often and falls
    short. A source without tokens gets rate 0 and its share goes to the others in proportion; NULL or not positive
    shares and caps below 1 count as not wanted; of a source listed twice the greatest share and cap count."""
    want = targets.select(source_name("source").alias("source"), F.col("target_share").alias("target_share"), F.col("max_repeats").alias("max_repeats"))
    want = want.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source IS NOT NULL")
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    both = want.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    usable = F.expr("coalesce(available > 0 AND target_share > 0 AND max_repeats >= 1, false)")
    size = both.where(usable).agg(F.sum("target_share").alias("_shares"), (F.lit(total) if total is not None else F.sum("available")).alias("_size"))
    both = both.crossJoin(F.broadcast(size))  # one row
    wanted = F.when(usable, F.col("target_share") / F.col("_shares") * F.col("_size")).otherwise(0.0)
    rate = F.when(usable, F.least(F.col("wanted") / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return both.withColumn("wanted", wanted).withColumn("rate", rate).drop("_shares", "_size")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 20, total: int | None = None, sized: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, tokens, copy): one row for each use of a document, copies counted from 1, never more
    than the cap. Documents of NULL or unlisted source aren't used; empty texts count 0 tokens and are used
    at the same rate. A document stored twice with the same id and text counts once."""
    sized = _sized(docs, targets) if sized is None else sized
    known = rates(sized, targets, total).select("source", "rate")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h"), F.lit(1 << 40)) / float(1 << 40)
    uses = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    used = sized.join(known, "source").withColumn("uses", uses).where("uses > 0")
    return used.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), "uses")).alias("copy"))


def shares(docs: DataFrame, targets: DataFrame, seed: int = 20, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, wanted, rate, tokens, share, shortfall): what each source reached:
    its tokens in the mixture, their share of it, and how many of the wanted ones are missing."""
    sized = _sized(docs, targets)
    got = mix(docs, targets, seed, total, sized).groupBy("source").agg(F.sum("tokens").alias("tokens"))
    got = rates(sized, targets, total).join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    whole = got.agg(F.sum("tokens").alias("_total"))
    got = got.crossJoin(F.broadcast(whole))  # one row
    share = F.when(F.col("_total") > 0, F.col("tokens") / F.col("_total")).otherwise(0.0)
    return got.withColumn("share", share).withColumn("shortfall", F.greatest(F.lit(0.0), F.col("wanted") - F.col("tokens"))).drop("_total")
