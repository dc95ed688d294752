"""Scores of systems against references, and the gate that keeps them from getting worse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.normalize import ocr_text
from ..functions.text import words


def pair_scores(rows: DataFrame, ref: str, hyp: str) -> DataFrame:
    """``rows`` with character and word error rates, raw and of the OCR-normalised texts."""
    made = rows.withColumn("_ref", ocr_text(F.col(ref))).withColumn("_hyp", ocr_text(F.col(hyp)))
    named = {"cer": metrics.cer(F.col(ref), F.col(hyp)), "wer": metrics.wer(F.col(ref), F.col(hyp)), "cer_norm": metrics.cer(F.col("_ref"), F.col("_hyp")), "wer_norm": metrics.wer(F.col("_ref"), F.col("_hyp"))}
    return made.select(*rows.columns, *[F.round(v, 6).alias(k) for k, v in named.items()])


def errors(ref: Column, hyp: Column) -> Column:
    """struct of the numbers that rates are made of: whole numbers, safe to sum."""
    r, h = words(ref), words(hyp)
    return F.struct(
        metrics.char_errors(ref, hyp).cast("long").alias("char_errors"),
        F.length(ref).cast("long").alias("chars"),
        metrics.token_errors(r, h).cast("long").alias("word_errors"),
        F.size(r).cast("long").alias("words"),
        (ref == hyp).cast("long").alias("exact"),
    )


def macro(rows: DataFrame, by: Sequence[str], rates: Sequence[str]) -> DataFrame:
    """(by..., n, rates...): means of the rows' own rates; zeros for no rows at all."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.coalesce(F.avg(r), F.lit(0.0)), 6).alias(r) for r in rates])


def micro(rows: DataFrame, by: str, errors_: str = "e") -> DataFrame:
    """(by, n, cer, wer, exact): rates of the summed errors for each value of ``by`` and, as 'all', for everything; a
    NULL value is named 'none'; no rows give none."""
    named = rows.select(F.coalesce(F.col(by), F.lit("none")).alias(by), F.col(f"{errors_}.*"))
    got = named.groupingSets([[by], []], by).agg(F.grouping(by).alias("_g"), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("char_errors", "chars", "word_errors", "words", "exact")])

    def rate(a: str, b: str) -> Column:
        return F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)

    return got.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(by)).alias(by), "n", rate("char_errors", "chars").alias("cer"), rate("word_errors", "words").alias("wer"), rate("exact", "n").alias("exact"))


def accuracy(rows: DataFrame, by: Sequence[str], right: str, gold: str, answered: str) -> DataFrame:
    """(by..., n, answered, scored, accuracy, coverage): right answers among the answered rows that have gold."""
    scored = F.col(answered) & F.col(gold)
    got = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(answered)).alias("answered"), F.count_if(scored).alias("scored"), F.count_if(scored & F.col(right)).alias("_right"))
    return got.select(*by, "n", "answered", "scored", F.round(F.col("_right") / F.greatest("scored", F.lit(1)), 6).alias("accuracy"), F.round(F.col("answered") / F.greatest("n", F.lit(1)), 6).alias("coverage"))


def regressions(now: DataFrame, baseline: DataFrame, system: str, rate: str, tolerance: float = 0.01) -> DataFrame:
    """(system, now, baseline): systems whose rate is above the baseline's by more than ``tolerance``. Systems without
    a baseline pass."""
    base = baseline.select(system, F.col(rate).alias("baseline"))
    return now.select(system, F.col(rate).alias("now")).join(base, system).where(F.col("now") > F.col("baseline") + tolerance)


def scoreboard(scores: DataFrame, system: str, rates: Sequence[str]) -> DataFrame:
    """(line): a Markdown table, one line for each system in order, the head first."""
    cells = [F.col(system).cast("string"), *[F.format_number(F.col(r), 3) for r in rates], F.col("n").cast("string")]
    body = scores.select(F.lit(2).alias("k"), F.col(system).alias("s"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    names = [system, *rates, "n"]
    head = scores.sparkSession.createDataFrame([(0, "", "| " + " | ".join(names) + " |"), (1, "", "|" + "---|" * len(names))], "k int, s string, line string")
    return head.unionByName(body).orderBy("k", "s").select("line")


def top_differences(rows: DataFrame, got: str, want: str, n: int = 40) -> DataFrame:
    """(ours, gold, n): the commonest differences between the words of two lines; ties by text."""
    flat = rows.select(F.explode(metrics.differences(words(F.col(got)), words(F.col(want)))).alias("d"))
    return flat.groupBy("d.ours", "d.gold").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ours", "gold").limit(n)
