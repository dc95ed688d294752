"""Queries over scores: error rates, accuracy, the gate and what differs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fold, metrics, text
from ..operators import scoring
from .registry import query, table

# Each answer is scored against the commonest answer to its item; both as plain ASCII, whose letters are single bytes for
# the SQL twin too.
_ASCII = "trim(regexp_replace(regexp_replace(lower(roman), '[^ -~]', '', 'g'), ' +', ' ', 'g'))"
_ANSWERS = f"SELECT DISTINCT item_id, provider_id, result_id, {_ASCII} AS hyp FROM translit_results WHERE ok AND roman IS NOT NULL"
_REFS = f"SELECT item_id, hyp AS ref FROM (SELECT item_id, hyp, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, hyp) AS k FROM ({_ANSWERS}) GROUP BY item_id, hyp) WHERE k = 1"
_PAIRS = f"SELECT a.*, r.ref FROM ({_ANSWERS}) a JOIN ({_REFS}) r USING (item_id)"


def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, provider_id, result_id, hyp, ref)."""
    ascii_ = F.trim(F.regexp_replace(F.regexp_replace(F.lower("roman"), "[^ -~]", ""), " +", " "))
    answers = table(spark, d, "translit_results").where("ok AND roman IS NOT NULL").select("item_id", "provider_id", "result_id", ascii_.alias("hyp")).distinct()
    counts = answers.groupBy("item_id", "hyp").agg(F.count("*").alias("n"))
    refs = counts.groupBy("item_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "hyp")).alias("b")).select("item_id", F.col("b.hyp").alias("ref"))
    return answers.join(refs, "item_id")


_CER = "CASE WHEN length(ref) = 0 THEN CASE WHEN length(hyp) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(ref, hyp)::DOUBLE / length(ref) END"


@query(f"SELECT result_id, round({_CER}, 6) AS cer FROM ({_PAIRS})")
def cer_pairs(spark: SparkSession, d: str) -> DataFrame:
    return scored_pairs(spark, d).select("result_id", F.round(metrics.cer(F.col("ref"), F.col("hyp")), 6).alias("cer"))


def _list(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda x: x <> '')"


# A word is one printable character by its place among the pair's words; a pair has fewer than 94.
_TOKENS = f"SELECT *, list_distinct(list_concat({_list('ref')}, {_list('hyp')})) AS v, {_list('ref')} AS r, {_list('hyp')} AS h FROM ({_PAIRS})"
_ERRORS = "levenshtein(list_aggregate(list_concat([''], list_transform(r, lambda t: chr(32 + list_position(v, t)::INT))), 'string_agg', ''), list_aggregate(list_concat([''], list_transform(h, lambda t: chr(32 + list_position(v, t)::INT))), 'string_agg', ''))"
_WER = f"CASE WHEN len(r) = 0 THEN CASE WHEN len(h) = 0 THEN 0.0 ELSE 1.0 END ELSE {_ERRORS}::DOUBLE / len(r) END"


@query(f"SELECT result_id, round({_WER}, 6) AS wer FROM ({_TOKENS})")
def wer_pairs(spark: SparkSession, d: str) -> DataFrame:
    return scored_pairs(spark, d).select("result_id", F.round(metrics.wer(F.col("ref"), F.col("hyp")), 6).alias("wer"))


@query(f"SELECT provider_id, count(*) AS n, round(avg(cer), 6) AS cer, round(avg(wer), 6) AS wer FROM (SELECT provider_id, {_CER} AS cer, {_WER} AS wer FROM ({_TOKENS})) GROUP BY provider_id")
def score_macro(spark: SparkSession, d: str) -> DataFrame:
    """Means of the answers' own rates by provider."""
    rows = scored_pairs(spark, d).withColumn("cer", metrics.cer(F.col("ref"), F.col("hyp"))).withColumn("wer", metrics.wer(F.col("ref"), F.col("hyp")))
    return scoring.macro(rows, ["provider_id"], ["cer", "wer"])


_SUMS = f"SELECT coalesce(kind, 'none') AS kind, levenshtein(ref, hyp) AS ce, length(ref) AS cn, {_ERRORS} AS we, len(r) AS wn, (ref = hyp)::INT AS ex FROM ({_TOKENS}) JOIN (SELECT DISTINCT item_id, kind FROM translit_items) USING (item_id)"


@query(f"SELECT CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, count(*) AS n, round(sum(ce)::DOUBLE / greatest(sum(cn), 1), 6) AS cer, round(sum(we)::DOUBLE / greatest(sum(wn), 1), 6) AS wer, round(sum(ex)::DOUBLE / count(*), 6) AS exact FROM ({_SUMS}) GROUP BY GROUPING SETS ((kind), ()) HAVING count(*) > 0")
def score_micro_sets(spark: SparkSession, d: str) -> DataFrame:
    """Rates of the summed errors by kind of item and over all."""
    kinds = table(spark, d, "translit_items").select("item_id", "kind").distinct()
    rows = scored_pairs(spark, d).join(kinds, "item_id").withColumn("e", scoring.errors(F.col("ref"), F.col("hyp")))
    return scoring.micro(rows, "kind")


_HALF = f"SELECT provider_id, item_id % 2 AS half, round(avg({_CER}), 6) AS cer FROM ({_PAIRS}) GROUP BY ALL"


@query(f"SELECT a.provider_id, a.cer AS now, b.cer AS baseline FROM ({_HALF}) a JOIN ({_HALF}) b USING (provider_id) WHERE a.half = 1 AND b.half = 0 AND a.cer > b.cer + 0.01")
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    """Providers that do worse on the odd items than on the even ones, which stand for the baseline run."""
    rows = scored_pairs(spark, d).withColumn("cer", metrics.cer(F.col("ref"), F.col("hyp"))).withColumn("half", F.col("item_id") % 2)
    runs = scoring.macro(rows, ["provider_id", "half"], ["cer"])
    return scoring.regressions(runs.where("half = 1"), runs.where("half = 0"), "provider_id", "cer")


_GOLD = fold.fold_gold_sql


@query(
    f"SELECT provider_id, count(*) AS n, count(*) FILTER (answered) AS answered, count(*) FILTER (answered AND gold IS NOT NULL) AS scored, round(count(*) FILTER (answered AND {_GOLD('devanagari')} = {_GOLD('gold')})::DOUBLE / greatest(count(*) FILTER (answered AND gold IS NOT NULL), 1), 6) AS accuracy, round(count(*) FILTER (answered)::DOUBLE / count(*), 6) AS coverage "
    "FROM (SELECT DISTINCT r.result_id, r.provider_id, r.devanagari, coalesce(r.ok AND r.devanagari <> '', false) AS answered, g.gold FROM (SELECT DISTINCT result_id, item_id, provider_id, ok, devanagari FROM translit_results) r JOIN (SELECT DISTINCT item_id, urdu FROM translit_items) i USING (item_id) LEFT JOIN (SELECT urdu, min(deva) AS gold FROM dictionary GROUP BY urdu) g ON i.urdu = g.urdu) GROUP BY provider_id"
)
def accuracy_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Providers against the dictionary: how much they answer and how much of that is right."""
    gold = table(spark, d, "dictionary").groupBy("urdu").agg(F.min("deva").alias("gold"))
    items = table(spark, d, "translit_items").select("item_id", "urdu").distinct().join(gold, "urdu", "left")
    rows = table(spark, d, "translit_results").select("result_id", "item_id", "provider_id", "ok", "devanagari").distinct().join(items, "item_id")
    answered = F.coalesce(F.col("ok") & (F.col("devanagari") != ""), F.lit(False))
    right = F.coalesce(fold.fold_gold(F.col("devanagari")) == fold.fold_gold(F.col("gold")), F.lit(False))
    rows = rows.select("provider_id", answered.alias("answered"), right.alias("right"), F.col("gold").isNotNull().alias("has_gold"))
    return scoring.accuracy(rows, ["provider_id"], "right", "has_gold", "answered")


@query()
def scoreboard(spark: SparkSession, d: str) -> DataFrame:
    """The macro scores as a Markdown table."""
    return scoring.scoreboard(score_macro(spark, d), "provider_id", ["cer", "wer"])


@query()
def word_lcs(spark: SparkSession, d: str) -> DataFrame:
    """Words of the reference met in order, by provider (no SQL twin: longest common subsequence)."""

    def kept(c: str):
        return F.filter(F.split(c, "[ -]+"), lambda x: (x != "") & ~x.isin("e", "o"))

    rows = scored_pairs(spark, d).select("provider_id", metrics.common_tokens(kept("ref"), kept("hyp")).cast("long").alias("ok"), F.size(kept("ref")).cast("long").alias("n"))
    return rows.groupBy("provider_id").agg(F.sum("ok").alias("right"), F.sum("n").alias("words"))


@query()
def diff_counts(spark: SparkSession, d: str) -> DataFrame:
    """The 40 commonest differences from the reference: a top-k report (no SQL twin: block matching)."""
    return scoring.top_differences(scored_pairs(spark, d), "hyp", "ref")


@query()
def ocr_pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """OCR results of a page against its most confident one's text, raw and normalised (no SQL twin: letters of two bytes)."""
    rows = table(spark, d, "ocr_results").where("ok AND text IS NOT NULL").select("result_id", "page_id", "provider_id", "text", "ms").distinct()
    ref = rows.groupBy("page_id").agg(F.min(F.struct("ms", "result_id", "text")).alias("b")).select("page_id", F.col("b.text").alias("ref"), F.col("b.result_id").alias("ref_id"))
    pairs_ = rows.join(ref, "page_id").where("result_id <> ref_id")
    return scoring.pair_scores(pairs_, "ref", "text").select("result_id", "provider_id", "cer", "wer", "cer_norm", "wer_norm")


@query()
def similarity_measures(spark: SparkSession, d: str) -> DataFrame:
    """The measures of likeness on one set of pairs (no SQL twin)."""
    rows = scored_pairs(spark, d)
    a, b = F.col("ref"), F.col("hyp")
    return rows.select("result_id", metrics.similarity(a, b).alias("similarity"), metrics.indel_ratio(a, b).alias("indel"), metrics.block_ratio(a, b).alias("blocks"), metrics.one_edit(a, b).alias("one_edit"), F.size(text.words(a)).alias("words"))
