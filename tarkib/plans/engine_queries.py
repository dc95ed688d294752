"""Queries over engines and streams: the batch matrix, pickers, resumed and followed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import letters
from ..operators import engines
from ..storage import shared_folder
from ..streaming import updates
from .registry import query, table

_OCR = "SELECT DISTINCT result_id, page_id AS file, provider_id AS ocr_engine, ok, text AS urdu, ms, error FROM ocr_results"
_TRANSLIT = "SELECT DISTINCT i.item_id AS file, r.provider_id AS translit_engine, r.devanagari, r.roman, r.roman_diacritic, r.ms, r.error, r.result_id FROM translit_results r JOIN (SELECT DISTINCT item_id FROM translit_items) i USING (item_id)"


@query(
    f"SELECT o.file, o.ocr_engine, o.urdu, t.translit_engine, t.devanagari, t.roman, t.roman_diacritic, (o.ms + coalesce(t.ms, 0))::INTEGER AS ms, coalesce(t.error, o.error) AS error FROM ({_OCR}) o LEFT JOIN ({_TRANSLIT}) t ON o.file = t.file AND o.ok AND coalesce(o.urdu, '') <> ''"
)
def batch_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every OCR result with the transliterations of the item of its number; failures as rows of their own."""
    ocr = table(spark, d, "ocr_results").select("result_id", F.col("page_id").alias("file"), F.col("provider_id").alias("ocr_engine"), "ok", F.col("text").alias("urdu"), "ms", "error").distinct()
    items = table(spark, d, "translit_items").select(F.col("item_id").alias("file")).distinct()
    t = table(spark, d, "translit_results").select(F.col("item_id").alias("file"), F.col("provider_id").alias("translit_engine"), "ok", "devanagari", "roman", "roman_diacritic", "ms", "error", "result_id").distinct().join(items, "file")
    t = ocr.select("file", "ocr_engine").distinct().join(t, "file")
    return engines.batch_matrix(ocr, t)


CURATED = ("sutlej", "ravi", "indus-2")


@query(
    f"SELECT provider_id, capability, label, kind, note, available, row_number() OVER (PARTITION BY capability ORDER BY CASE WHEN cur THEN list_position({list(CURATED)}, provider_id) ELSE 0 END, available DESC, lower(label), provider_id)::INTEGER AS place FROM (SELECT *, kind <> 'api' AS available, bool_or(provider_id IN {CURATED}) OVER (PARTITION BY capability) AS cur FROM providers) WHERE NOT cur OR provider_id IN {CURATED}"
)
def engine_picker(spark: SparkSession, d: str) -> DataFrame:
    """Engines as a picker lists them: a curated list for one step, all for the other."""
    return engines.picker(table(spark, d, "providers"), F.col("kind") != "api", CURATED)


def _broken(x: str) -> str:
    raise ValueError("no reading")


def registry() -> engines.Registry:
    r = engines.Registry()
    r.add(engines.Engine("letters", "translit", "Letter rules", lambda x: letters.read_word(x)[1]))
    r.add(engines.Engine("broken", "translit", "Always fails", _broken, ready=lambda: False))
    return r


@query("SELECT item_id, 'broken' AS provider_id, 1 AS position, false AS ok, 'ValueError: no reading' AS error FROM (SELECT DISTINCT item_id FROM translit_items WHERE kind = 'word') UNION ALL SELECT item_id, 'absent', 2, false, 'unknown provider' FROM (SELECT DISTINCT item_id FROM translit_items WHERE kind = 'word') UNION ALL SELECT item_id, 'letters', 0, true, NULL FROM (SELECT DISTINCT item_id FROM translit_items WHERE kind = 'word' AND urdu IS NOT NULL)")
def engine_runs(spark: SparkSession, d: str) -> DataFrame:
    """Words through three engines, one of which fails and one of which isn't there: errors are rows."""
    words = table(spark, d, "translit_items").where("kind = 'word'").select("item_id", "urdu").distinct()
    got = engines.run_all(words, "urdu", registry(), "translit", ["letters", "broken", "absent"])
    return got.where("urdu IS NOT NULL OR provider_id <> 'letters'").select("item_id", "provider_id", "position", "ok", "error")


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share, beside the checkpoints."""
    return f"{shared_folder(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


@query("SELECT DISTINCT train_id, src, tgt FROM train")
def stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """Training rows as a stream, each id once, in two goes: the second finds nothing left to do."""
    rows = table(spark, d, "train").select("train_id", "src", "tgt")
    out = _folder(spark)
    for _ in range(2):
        source = spark.readStream.schema(rows.schema).option("pathGlobFilter", "train.parquet").parquet(d)
        updates.build_once(source, ["train_id"], lambda df: df, f"{out}/rows", f"{out}/progress").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


@query("SELECT item_id, provider_id, arg_max(result_id, (created_at, result_id)) AS result_id FROM (SELECT DISTINCT item_id, provider_id, result_id, created_at FROM translit_results) GROUP BY ALL")
def stream_follow(spark: SparkSession, d: str) -> DataFrame:
    """The latest answer of each provider to each item, kept up from a stream of answers."""
    rows = table(spark, d, "translit_results").select("item_id", "provider_id", "result_id", "created_at")
    source = spark.readStream.schema(rows.schema).option("pathGlobFilter", "translit_results.parquet").parquet(d)
    out = _folder(spark)
    updates.follow(source, ["item_id", "provider_id"], ["created_at", "result_id"], f"{out}/table", f"{out}/progress", 8).awaitTermination()
    return updates.current(spark, f"{out}/table", rows.schema).select("item_id", "provider_id", "result_id")
