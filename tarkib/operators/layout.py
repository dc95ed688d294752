"""Reading order of OCR words: columns, lines and directions, and the way back to the page's own coordinates.

Column cuts are a window over the boxes; bucketing into lines depends on the order of the words and runs in pandas
on one page's words at a time, a bounded group.
"""

from __future__ import annotations

import re
import statistics
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The least gap between columns in pixels and in median word widths; share of a line's height that
#: centres may differ by.
LEAST_GAP, GAP_WIDTHS, LINE_TOLERANCE = 60.0, 8.0, 0.6


@dataclass(frozen=True)
class OcrOptions:
    """What an OCR run is asked for; engines take the rest from ``engine``."""

    grayscale: bool = True
    upscale_min_text_px: int = 22
    max_upscale: float = 3.0
    denoise: bool = True
    clahe: bool = True
    binarize: str = "sauvola"
    deskew: bool = True
    deskew_max_deg: float = 15.0
    pad: int = 12
    line_y_tol_frac: float = LINE_TOLERANCE
    map_digits_to: str = "ascii"
    fold_arabic_heh: bool = False
    spellfix: bool = False
    engine: tuple[tuple[str, str], ...] = ()


def geometry(box: Column) -> Column:
    """struct<cx, cy, left, right, top, bottom, width, height>; a width or height of nothing counts as 1. NULL and
    empty boxes give NULL."""
    xs, ys = F.transform(box, lambda p: p["x"]), F.transform(box, lambda p: p["y"])

    def mean(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("double"), lambda s, x: s + x) / F.size(a)

    def extent(a: Column) -> Column:
        d = (F.array_max(a) - F.array_min(a)).cast("double")
        return F.when(d == 0, 1.0).otherwise(d)

    made = F.struct(
        mean(xs).alias("cx"), mean(ys).alias("cy"), F.array_min(xs).alias("left"), F.array_max(xs).alias("right"), F.array_min(ys).alias("top"), F.array_max(ys).alias("bottom"),
        extent(xs).alias("width"), extent(ys).alias("height"),
    )
    return F.when(F.size(box) > 0, made)


def unmapped(x: Column, y: Column, scale: Column, angle: Column, pad: Column, width: Column, height: Column) -> Column:
    """struct<x, y>: a point of the prepared image on the page it was made from: padding, scale and rotation undone."""
    px, py = (x - pad) / scale - width / 2, (y - pad) / scale - height / 2
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return F.struct(F.round(c * px + s * py + width / 2).cast("int").alias("x"), F.round(c * py - s * px + height / 2).cast("int").alias("y"))


def column_cuts(words: DataFrame, page: str, box: str = "box") -> DataFrame:
    """(page, cut): where a page's columns part: gaps between boxes wider than any word could leave. Pages of fewer than
    four words, or of one level, have one column."""
    g = words.select(page, geometry(F.col(box)).alias("g")).where("g IS NOT NULL").select(page, "g.*")
    level = F.bround(F.col("cy") / 5).cast("bigint")
    sizes = g.groupBy(page).agg(F.count("*").alias("n"), F.countDistinct(level).alias("levels"), F.median("width").alias("median_width"))
    wide = sizes.where("n >= 4 AND levels >= 2").select(page, F.greatest(F.lit(LEAST_GAP), GAP_WIDTHS * F.col("median_width")).alias("gap"))
    before = Window.partitionBy(page).orderBy("left", "right").rowsBetween(Window.unboundedPreceding, -1)
    spans = g.withColumn("end", F.max("right").over(before)).join(wide, page)
    return spans.where(F.col("left") - F.col("end") > F.col("gap")).select(page, ((F.col("end") + F.col("left")) / 2).alias("cut"))


def in_columns(words: DataFrame, cuts: DataFrame, page: str, box: str = "box") -> DataFrame:
    """``words`` with ``column``: how many of the page's cuts are left of the word's centre."""
    packed = cuts.groupBy(page).agg(F.collect_list("cut").alias("_cuts"))
    out = words.join(packed, page, "left").withColumn("_cx", geometry(F.col(box))["cx"])
    return out.withColumn("column", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_cx"))), F.lit(0))).drop("_cuts", "_cx")


_LEFT_TO_RIGHT = re.compile(r"(?=.*[A-Za-z0-9])[^؀-ۿ]{2,}", re.S)


def line_text(words: list[str]) -> str:
    """Words from right to left, each run of Latin words or numbers turned back."""
    out: list[str] = []
    run: list[str] = []
    for w in [*words, None]:
        if w is not None and _LEFT_TO_RIGHT.fullmatch(w):
            run.insert(0, w)
            continue
        out += run
        run = []
        if w is not None:
            out.append(w)
    return " ".join(out)


def _page_lines(page: pd.DataFrame, tolerance: float) -> list[tuple]:
    out = []
    columns = sorted(page.groupby("column"), key=lambda kv: (-kv[1]["cx"].mean(), kv[0]))
    for _, words in columns:
        near = tolerance * statistics.median(words["height"])
        rows: list[list] = []
        for w in words.sort_values(["cy", "cx", "text"], kind="stable").itertuples(index=False):
            home = next((r for r in rows if abs(w.cy - statistics.fmean(x.cy for x in r)) <= near), None)
            rows.append([w]) if home is None else home.append(w)
        for r in sorted(rows, key=lambda r: min(x.top for x in r)):
            ordered = sorted(r, key=lambda x: -x.cx)
            confs = [x.conf for x in ordered if x.conf == x.conf and x.conf is not None]
            out.append((line_text([x.text for x in ordered]), min(x.left for x in r), min(x.top for x in r), max(x.right for x in r), max(x.bottom for x in r), statistics.fmean(confs) if confs else None))
    return out


def lines_in_order(words: DataFrame, page: str, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """(page, line_no, text, left, top, right, bottom, conf): a page's words (text, box, conf) as lines in reading order:
    the right column first, lines from the top, words from the right, Latin runs from the left. Words without box or
    text are left out; a line's conf is the mean of those known."""
    kept = in_columns(words, column_cuts(words, page), page).where("text IS NOT NULL").withColumn("g", geometry(F.col("box"))).where("g IS NOT NULL")
    flat = kept.select(page, "column", "text", F.col("conf").cast("double").alias("conf"), "g.cx", "g.cy", "g.left", "g.right", "g.top", "g.bottom", "g.height")
    names = ["line_no", "text", "left", "top", "right", "bottom", "conf"]

    def run(df: pd.DataFrame) -> pd.DataFrame:
        rows = [(i, *r) for i, r in enumerate(_page_lines(df, tolerance))]
        got = pd.DataFrame(rows, columns=names)
        got.insert(0, page, df[page].iloc[0])
        return got

    schema = T.StructType([flat.schema[page]] + [T.StructField(n, t) for n, t in zip(names, [T.IntegerType(), T.StringType(), *[T.IntegerType()] * 4, T.DoubleType()], strict=True)])
    return flat.groupBy(page).applyInPandas(run, schema)


def page_text(lines: DataFrame, page: str) -> DataFrame:
    packed = lines.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return packed.select(page, F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


_WORDS = "array<struct<text:string,box:array<struct<x:int,y:int>>,conf:double>>"


def parsed_boxes(answer: Column) -> Column:
    """An engine's JSON answer, {"words": [{text, box, conf}]}, as an array of words; anything else gives none."""
    got = F.from_json(answer, f"struct<words:{_WORDS}>")["words"]
    return F.filter(F.coalesce(got, F.array().cast(_WORDS)), lambda w: w["text"].isNotNull() & (F.size(w["box"]) > 0))


def recognised(images: DataFrame, page: str, recognise, options: OcrOptions | None = None) -> DataFrame:
    """(page, ok, error, text): images (page, content) through any ``recognise(bytes, options)`` that gives (text, box,
    conf) words, put in order and normalised. An image that fails is a row with its error, never a failed job."""
    from ..functions.normalize import ocr_text

    options = options or OcrOptions()
    read = T.StructType([images.schema[page], T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("words", _words_type())])

    def run(batches):
        for b in batches:
            rows = []
            for key, content in zip(b[page], b["content"], strict=True):
                try:
                    words = [{"text": t, "box": [{"x": int(x), "y": int(y)} for x, y in box], "conf": float(c)} for t, box, c in recognise(bytes(content), options)]
                    rows.append((key, True, None, words))
                except Exception as e:  # noqa: BLE001 - a failure is data
                    rows.append((key, False, f"{type(e).__name__}: {e}", []))
            yield pd.DataFrame(rows, columns=[page, "ok", "error", "words"])

    got = images.select(page, "content").mapInPandas(run, read)
    words = got.where("ok").select(page, F.explode("words").alias("w")).select(page, "w.*")
    texts = page_text(lines_in_order(words, page, options.line_y_tol_frac), page)
    shown = ocr_text(F.coalesce("text", F.lit("")), options.map_digits_to, options.fold_arabic_heh)
    return got.select(page, "ok", "error").join(texts, page, "left").select(page, "ok", "error", F.when(F.col("ok"), shown).alias("text"))


def _words_type() -> T.ArrayType:
    point = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
    return T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("box", T.ArrayType(point)), T.StructField("conf", T.DoubleType())]))
