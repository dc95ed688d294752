"""Writers of lexicons, data sets and reports. Spark's own committers make every write whole or absent."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sets import latest, without


def lexicon_json(df: DataFrame, path: str, key: str, values: Sequence[str]) -> None:
    """One JSON object a line, {"key":..., "value":[...]}, gzipped, keys in order across the files."""
    df.select(F.col(key).alias("key"), F.array(*[F.col(v) for v in values]).alias("value")).orderBy("key").write.mode("overwrite").option("compression", "gzip").json(path)


def dictionary_tsv(df: DataFrame, path: str, columns: Sequence[str], count: str) -> None:
    """A dictionary as text in the order of its counts: files follow each other by name. The head line is one file of
    its own before them, so that no single task has to hold the whole table."""
    body = df.orderBy(F.desc(count), columns[0]).select(F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in columns]).alias("value"))
    body.write.mode("overwrite").text(os.path.join(path, "body"))
    df.sparkSession.createDataFrame([("# " + "\t".join(columns),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "0-head"))


def training_rows(df: DataFrame, weight: str = "weight", most: float = 4.0) -> DataFrame:
    """(task, src, tgt, w): weights summed, capped and written with two digits."""
    got = df.groupBy("task", "src", "tgt").agg(F.sum(F.col(weight).cast("decimal(18,3)")).alias("w"))
    return got.select("task", "src", "tgt", F.round(F.least(F.col("w"), F.lit(most).cast("decimal(18,3)")), 2).cast("decimal(6,2)").cast("string").alias("w"))


def training_tsv(df: DataFrame, path: str, split: str) -> None:
    """Rows of each split in a folder of its own, tab-separated; tabs and line breaks in texts become blanks."""
    flat = [F.regexp_replace(F.col(c).cast("string"), "[\t\n\r]+", " ") for c in ("task", "src", "tgt", "w")]
    df.select(F.col(split), F.concat_ws("\t", *flat).alias("value")).write.mode("overwrite").partitionBy(split).text(path)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Appends as JSON the rows whose key isn't there yet, once each: a run taken up again."""
    spark = rows.sparkSession
    try:
        done = spark.read.schema(rows.schema).json(path)
    except Exception:  # noqa: BLE001 - nothing there yet
        done = spark.createDataFrame([], rows.schema)
    without(rows, done, key).dropDuplicates([key]).write.mode("append").json(path)


def missing_references(fixtures: DataFrame, references: DataFrame, key: str, refresh: bool = False) -> DataFrame:
    """Fixtures that still need a reference; all of them on ``refresh``."""
    return fixtures if refresh else without(fixtures, references, key)


def upserted(log: DataFrame, changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A log of corrections with new lines in place of the old ones of the same key."""
    return latest(log.unionByName(changes), key, order)


def label_lines(df: DataFrame, file: Column, text: Column) -> DataFrame:
    """(value): lines of a label file."""
    return df.select(F.concat_ws("\t", file, F.regexp_replace(text, "[\t\n\r]+", " ")).alias("value"))


def recognition_labels(labels: DataFrame, kind: str, root: str = "") -> DataFrame:
    """(value): label lines (file, text) of a trainer: ``paddle`` and ``dtrb`` both take path, tab, text, the first with
    the image root before it."""
    if kind not in ("paddle", "dtrb"):
        raise ValueError("kind: paddle or dtrb")
    file = F.concat(F.lit(root.rstrip("/") + "/" if root else ""), F.col("file")) if kind == "paddle" else F.concat(F.lit(root), F.col("file"))
    return label_lines(labels.where("text <> ''"), file, F.col("text"))


def image_sets(df: DataFrame, path: str, split: str, file: str, content: str, text: str) -> None:
    """Images of each split in its folder with a label file beside them: the images are written by the tasks that hold
    them, the labels by Spark. ``path`` must be a folder all executors share."""

    def run(batches):
        for b in batches:
            for s, f, c in zip(b[split], b[file], b[content], strict=True):
                folder = os.path.join(path, s, "images")
                os.makedirs(folder, exist_ok=True)
                part = os.path.join(folder, f".{f}.{os.getpid()}")
                with open(part, "wb") as out:
                    out.write(bytes(c))
                os.replace(part, os.path.join(folder, f))
            yield b[[split]].groupby(split).size().reset_index(name="n")

    df.select(split, file, content).mapInPandas(run, f"{split} string, n long").groupBy(split).agg(F.sum("n")).collect()
    df.select(split, F.concat_ws("\t", F.concat(F.lit("images/"), F.col(file)), F.regexp_replace(text, "[\t\n\r]+", " ")).alias("value")).write.mode("overwrite").partitionBy(split).text(os.path.join(path, "labels"))


def accepted(titles: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Titles still to fetch: neither found nor known to be missing (``done``: title, entry, NULL for a miss), in order,
    at most as many as entries lack up to ``limit``: a build's budget."""
    todo = without(titles, done, "title")
    if limit is None:
        return todo
    have = done.where("entry IS NOT NULL").count()
    return todo.orderBy("title").limit(max(0, limit - have))
