"""Choosing among readings: reranking by evidence, a teacher unless it is broken, meter against misread lines."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fold, lining, meter, metrics

#: Weight of human evidence, of a model's own casual readings, bonus of a known word.
EVIDENCE, CASUAL, KNOWN = 2.0, 4.0, 2.0


def scaled(evidence: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """(key, value, w): evidence scaled to at most ``EVIDENCE`` in all, less where there is little of it."""
    total = evidence.groupBy(key).agg(F.sum(weight).alias("_total"))
    scale = EVIDENCE * F.least(F.lit(1.0), F.col("_total") / 2.0) / F.col("_total")
    return evidence.join(total, key).select(key, value, (F.col(weight) * scale).alias("w"))


def softmax(hyps: DataFrame, key: str, value: str, score: str) -> DataFrame:
    """(key, value, w): a beam's scores as weights that add up to ``CASUAL``."""
    best = hyps.groupBy(key).agg(F.max(score).alias("_best"))
    p = hyps.join(best, key).withColumn("p", F.exp(F.col(score) - F.col("_best")))
    z = p.groupBy(key).agg(F.sum("p").alias("_z"))
    return p.join(z, key).select(key, value, (CASUAL * F.col("p") / F.col("_z")).alias("w"))


def reranked(hyps: DataFrame, key: str, evidence: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(key, rich, devanagari, score): the best of a beam (key, pos, rich, plain, devanagari, score): its score, plus
    evidence (key, roman, w) weighted by the squared likeness of the folded, degeminated spellings, plus a bonus if the
    Devanagari is a known word (key, word folded). Equal scores: the earlier hypothesis."""

    def folded(c: str) -> Column:
        return fold.degeminated(fold.fold_roman(F.col(c)))

    h = hyps.withColumn("_f", folded("plain")).withColumn("_h", fold.fold_hindi(F.col("devanagari")))
    e = evidence.select(key, folded("roman").alias("_e"), "w")
    like = h.join(e, key).select(key, "pos", (F.col("w") * F.pow(metrics.block_ratio("_f", "_e"), 2.0)).alias("g")).groupBy(key, "pos").agg(F.sum("g").alias("gain"))
    out = h.join(like, [key, "pos"], "left").withColumn("total", F.col("score") + F.coalesce("gain", F.lit(0.0)))
    if known is not None:
        out = out.join(known.select(key, F.col("word").alias("_h"), F.lit(KNOWN).alias("_bonus")).distinct(), [key, "_h"], "left").withColumn("total", F.col("total") + F.coalesce("_bonus", F.lit(0.0)))
    best = out.groupBy(key).agg(F.min(F.struct((-F.col("total")).alias("t"), "pos", "rich", "devanagari")).alias("b"))
    return best.select(key, "b.rich", "b.devanagari", F.round(-F.col("b.t"), 6).alias("score"))


def overruled(readings: DataFrame, evidence: DataFrame, key: str, least: float = 5, share: float = 0.6, unlike: float = 0.75) -> DataFrame:
    """``readings`` (key, plain) with ``override``: the spelling that most people use where there is enough evidence
    (key, roman, w), it is clearly the commonest, and the reading is nothing like it; else NULL."""
    total = evidence.groupBy(key).agg(F.sum("w").alias("_total"), F.min(F.struct((-F.col("w")).alias("w"), "roman")).alias("_top"))
    strong = total.where((F.col("_total") >= least) & (-F.col("_top.w") >= share * F.col("_total"))).select(key, F.col("_top.roman").alias("_roman"))

    def folded(c: Column) -> Column:
        return fold.degeminated(fold.fold_roman(c))

    out = readings.join(strong, key, "left")
    return out.withColumn("override", F.when(F.col("_roman").isNotNull() & (metrics.block_ratio(folded(F.col("plain")), folded(F.col("_roman"))) < unlike), F.col("_roman"))).drop("_roman")


def chosen(teacher: DataFrame, candidates: DataFrame, key: str, prior: float = 0.3, margin: float = 0.3) -> DataFrame:
    """(key, text, source): the teacher's reading (key, text, sound, lp) where it is sound; else the candidate (key,
    text, score, lp) of the best lp + prior x score, unless the teacher's own lp is within ``margin`` of that one's;
    with no candidate the teacher's reading, whatever it is. Equal candidates: the better lp, then the lesser text."""
    rank = F.struct((-(F.col("lp") + prior * F.col("score"))).alias("t"), (-F.col("lp")).alias("l"), "text")
    best = candidates.groupBy(key).agg(F.min(rank).alias("b")).select(key, F.col("b.text").alias("_text"), (-F.col("b.l")).alias("_lp"))
    out = teacher.join(best, key, "left")
    keep = F.col("sound") | F.col("_text").isNull() | F.coalesce(F.col("lp") >= F.col("_lp") - margin, F.lit(False))
    return out.select(key, F.when(keep, F.col("text")).otherwise(F.col("_text")).alias("text"), F.when(keep, "teacher").otherwise("candidate").alias("source"))


# --- meter ----------------------------------------------------------------------------------------
#: A task compares at most about so many of a poem's kinds of lines with so many others; the results don't depend on it.
COMPARED, AMONG = 1 << 12, 1 << 16


def meter_support(lines: DataFrame, poem: Sequence[str], line: str, rich: str) -> DataFrame:
    """(poem..., line, support, others): with how many of the poem's other lines each can share a meter. Lines with one
    scansion are compared once, so repeated lines cost nothing. A long poem is dealt to tasks in blocks of kinds, each
    compared at once with a block of others."""
    spark = lines.sparkSession
    scanned = lines.select(*poem, line, meter.line_weights(F.col(rich)).alias("w")).where(F.size("w") > 0).select(*poem, line, meter.coded(F.col("w")).alias("k"))
    kinds = scanned.groupBy(*poem, "k").agg(F.count("*").alias("n"))
    size = kinds.groupBy(*poem).agg((F.sum("n") - 1).alias("others"), F.ceil(F.count("*") / COMPARED).alias("_of"), F.ceil(F.count("*") / AMONG).alias("_among"))
    dealt = kinds.join(size, list(poem))
    block, tasks = [*poem, "_a", "_b"], 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def each(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))

    def own(blocks: str) -> Column:
        return F.pmod(F.xxhash64("k"), F.col(blocks))

    a = dealt.select(*poem, "k", own("_of").alias("_a"), each("_among").alias("_b"))
    b = dealt.select(*[F.col(p).alias(p) for p in poem], F.col("k").alias("k"), "n", own("_among").alias("_b"), each("_of").alias("_a"))

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return x[[*poem, "k"]].assign(support=meter.fitting(x["k"].tolist(), y["k"].tolist(), y["n"].to_numpy()))

    fits = a.repartition(tasks, *block).groupBy(*block).cogroup(b.repartition(tasks, *block).groupBy(*block))
    kind = T.StructType([*(kinds.schema[p] for p in poem), T.StructField("k", T.StringType()), T.StructField("support", T.LongType())])
    total = fits.applyInPandas(compare, kind).groupBy(*poem, "k").agg((F.sum("support") - 1).alias("support"))  # itself left out
    return scanned.join(total, [*poem, "k"]).join(size, list(poem)).select(*poem, line, "support", "others")


#: Share of the other lines below which a line is doubted, most loss of likelihood, least gain of lines.
DOUBT, LOSS, GAIN, LEAST_LINES = 0.3, 0.1, 4, 4
_REREAD = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())])


def reread(lines: list[tuple[str, str, float, list[tuple[str, str, float]]]]) -> list[str]:
    """The texts of a poem's lines (text, rich, lp, candidates), a line replaced by a candidate (text, rich, lp) that is
    about as likely and scans with clearly more of the other lines. Fewer than four lines stay as they are."""
    weights = [meter.syllables(rich) if rich else [] for _, rich, _, _ in lines]
    others = sum(map(bool, weights)) - 1
    out = [text for text, *_ in lines]
    if len(lines) < LEAST_LINES or others < LEAST_LINES - 1:
        return out
    for i, (_, _, lp, candidates) in enumerate(lines):
        now = meter.support(weights, weights[i], i)
        if not weights[i] or now >= DOUBT * others:
            continue
        scored = [(meter.support(weights, meter.syllables(r), i), p, t) for t, r, p in candidates if p >= lp - LOSS]
        good = [s for s in scored if s[0] >= max(DOUBT * others, now + GAIN)]
        if good:
            out[i] = max(good)[2]
    return out


def izafat_toggles(urdu: str, deva: str) -> list[str]:
    """The readings with one izafat added between two words or taken away."""
    units = lining.deva_units(deva)
    spans = lining.line_up(urdu.split(), units) or []
    out = []
    for _, _, _, j in spans[:-1]:
        swap = {" ": "-e-", "-e-": " "}.get(units[j - 1][1])
        if swap:
            changed = [[w, swap if k == j - 1 else s] for k, (w, s) in enumerate(units)]
            out.append("".join(w + (s.replace("-e-", "-ए-") if k < len(changed) - 1 else "") for k, (w, s) in enumerate(changed)))
    return out


def likeness(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def pick_schwa(votes: pd.Series, candidates: list[str], key) -> str:
    """The candidate with most votes under ``key``, the earlier of equal ones."""
    return min(candidates, key=lambda c: (-float(votes.get(key(c), 0.0)), candidates.index(c)))
