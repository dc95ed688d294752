"""The queries of this subpackage: pN_... for problem N."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import consensus, defects, mixing, overlap, scans, spans, splits, text_forms, tokens
from .common import table


def _shares(spark: SparkSession, d: str) -> dict[str, float]:
    """The wanted splits, a fixed table of a few rows; more than a hundred are taken for a mistake."""
    rows = table(spark, d, "split_targets").where("split IS NOT NULL AND share > 0").limit(101).collect()
    if len(rows) > 100:
        raise ValueError("more than a hundred splits")
    return {r.split: float(r.share) for r in rows}


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "test"), table(spark, d, "train"), "test_id", "urdu", "train_id", "src")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.col("a").alias("test_id"), F.col("b").alias("train_id"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "test"), _overlaps(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "translit_results"), table(spark, d, "translit_items")).drop("chance")


def _learned(spark: SparkSession, d: str) -> DataFrame:
    return consensus.learned_tasks(table(spark, d, "translit_results"), table(spark, d, "translit_items"))


def p2_posteriors(spark: SparkSession, d: str) -> DataFrame:
    return consensus.posteriors(_learned(spark, d))


def p2_difficulty(spark: SparkSession, d: str) -> DataFrame:
    return consensus.difficulty(_learned(spark, d))


def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(table(spark, d, "translit_results"), table(spark, d, "translit_items"))


def p2_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliability(table(spark, d, "translit_results"), table(spark, d, "translit_items"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.same_group_names(table(spark, d, "teacher_labels"))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "teacher_labels").select("label_id", "id", "src", "grp").distinct()
    return splits.assign(splits.with_component(rows, "src", "grp", ["id"], ["label_id"]), _shares(spark, d))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("label_id", "split")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("component").alias("components"))


_ALIKE = (("ocr_results", "result_id", "text", "page_id"), ("test", "test_id", "urdu", None), ("translit_results", "result_id", "devanagari", "item_id"))


def _each_field(spark: SparkSession, d: str, operator) -> DataFrame:
    out = None
    for name, row_id, text, within in _ALIKE:
        got = operator(table(spark, d, name), row_id, text, within)
        got = got.select(F.lit(f"{name}.{text}").alias("field"), *got.columns)
        out = got if out is None else out.unionByName(got)
    return out


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _each_field(spark, d, text_forms.look_alikes)


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return _each_field(spark, d, text_forms.form_classes)


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, row_id, text in (("ocr_results", "result_id", "text"), ("test", "test_id", "urdu"), ("translit_results", "result_id", "devanagari")):
        rows = table(spark, d, name).select(F.lit(f"{name}.{text}").alias("field"), F.col(row_id).alias("id"), F.col(text).alias("stored")).distinct()
        got = text_forms.unify(rows, "stored").drop("stored")
        out = got if out is None else out.unionByName(got)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(table(spark, d, "ocr_lines"), table(spark, d, "ocr_results"), table(spark, d, "dictionary"))


def p5_pages(spark: SparkSession, d: str) -> DataFrame:
    return scans.pages(table(spark, d, "ocr_lines"), table(spark, d, "ocr_results"), table(spark, d, "dictionary"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.defects(table(spark, d, "teacher_labels"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text isn't what its ids decode to: none."""
    docs = table(spark, d, "documents")
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = tokens.encode_corpus(named).withColumn("h", F.lit(0))
    back = tokens.decode_corpus(ids).select("doc_id", F.col("text").alias("back"))
    return named.distinct().join(back, "doc_id").where("text <> back").select("doc_id")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_documents(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_classes(table(spark, d, "documents"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_amount(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("p") and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
