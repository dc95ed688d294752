"""Queries over OCR geometry: boxes, columns, reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout
from .registry import query, table

_XS = "list_transform(box, lambda p: p.x)"
_YS = "list_transform(box, lambda p: p.y)"
_G = f"SELECT line_id, result_id, list_avg({_XS}) AS cx, list_avg({_YS}) AS cy, list_min({_XS}) AS \"left\", list_max({_XS}) AS \"right\", list_min({_YS}) AS top, list_max({_YS}) AS bottom FROM (SELECT DISTINCT line_id, result_id, box FROM ocr_lines) WHERE len(box) > 0"
_W = "CASE WHEN \"right\" = \"left\" THEN 1.0 ELSE (\"right\" - \"left\")::DOUBLE END"
_H = "CASE WHEN bottom = top THEN 1.0 ELSE (bottom - top)::DOUBLE END"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_lines").select("line_id", "result_id", "text", "box", "conf").distinct()


@query(f"SELECT line_id, round(cx, 6) AS cx, round(cy, 6) AS cy, {_W} AS width, {_H} AS height FROM ({_G})")
def box_geometry(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).select("line_id", layout.geometry(F.col("box")).alias("g")).where("g IS NOT NULL")
    return rows.select("line_id", F.round("g.cx", 6).alias("cx"), F.round("g.cy", 6).alias("cy"), "g.width", "g.height")


@query(
    f"WITH g AS ({_G}), s AS (SELECT result_id, count(*) AS n, count(DISTINCT round_even(cy / 5, 0)) AS levels, median({_W}) AS mw FROM g GROUP BY result_id), "
    "e AS (SELECT g.result_id, \"left\", max(\"right\") OVER (PARTITION BY g.result_id ORDER BY \"left\", \"right\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM g) "
    "SELECT result_id, (last + \"left\") / 2.0 AS cut FROM e JOIN s USING (result_id) WHERE n >= 4 AND levels >= 2 AND \"left\" - last > greatest(60.0, 8.0 * mw)"
)
def column_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Where the pages' columns part, their lines being the boxes."""
    return layout.column_cuts(_lines(spark, d), "result_id")


#: Word boxes of a page in two columns with a Latin run: (text, x, y).
PAGE = [("R1", 500, 0), ("R2", 500, 40), ("L1", 0, 0), ("L2", 0, 40)]
PAGE_2 = [("یہ", 300, 0), ("GPT", 200, 0), ("OpenAI", 130, 0), ("ہے", 0, 0)]


@query("SELECT * FROM (VALUES (1, 0, 'R1'), (1, 1, 'R2'), (1, 2, 'L1'), (1, 3, 'L2'), (2, 0, 'یہ OpenAI GPT ہے')) t(page, line_no, text)")
def reading_order_cases(spark: SparkSession, d: str) -> DataFrame:
    """Two small pages in reading order (a golden: the SQL only lists what is right)."""
    rows = [(p, t, [(x, y), (x + 20, y), (x + 20, y + 16), (x, y + 16)], 0.9) for p, page in ((1, PAGE), (2, PAGE_2)) for t, x, y in page]
    words = spark.createDataFrame(rows, "page int, text string, box array<struct<x:int,y:int>>, conf double")
    return layout.lines_in_order(words, "page").select("page", "line_no", "text")


@query()
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Every page's lines put in order from their boxes alone (no SQL twin: bucketing depends on the order of boxes)."""
    return layout.page_text(layout.lines_in_order(_lines(spark, d), "result_id"), "result_id")


@query("SELECT DISTINCT line_id, round((list_avg(list_transform(box, lambda p: p.x)) - 12) / 2.0, 3) AS x FROM ocr_lines WHERE len(box) > 0")
def box_unmapped(spark: SparkSession, d: str) -> DataFrame:
    """Centres of boxes on the page before it was padded by 12 and doubled; no rotation."""
    rows = _lines(spark, d).select("line_id", layout.geometry(F.col("box")).alias("g")).where("g IS NOT NULL")
    return rows.select("line_id", F.round((F.col("g.cx") - 12) / 2.0, 3).alias("x"))


@query("SELECT result_id, (sum(round(conf * 1000)::BIGINT) // count(conf))::BIGINT AS thousandths, count(*) AS lines FROM (SELECT DISTINCT line_id, result_id, conf FROM ocr_lines) GROUP BY result_id HAVING count(conf) > 0")
def page_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Mean confidence of a page's lines; unknown ones don't count."""
    got = _lines(spark, d).groupBy("result_id").agg(F.sum(F.round(F.col("conf") * 1000).cast("long")).alias("s"), F.count("conf").alias("k"), F.count("*").alias("lines"))
    return got.where("k > 0").select("result_id", F.expr("s div k").alias("thousandths"), "lines")
