"""Streams: a build that is taken up where it was left, a table that follows a log, rows as they come.

All of them are Structured Streaming queries whose progress lives in a checkpoint folder the caller names: one that
all executors share.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.sets import latest


def stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files: int | None = None) -> DataFrame:
    """Files of a folder as a stream; ``files`` at most in a batch."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.format(kind).load(path)


def build_once(source: DataFrame, key: Sequence[str], make: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, late: str | None = None, within: str = "30 days") -> StreamingQuery:
    """Works off what has come, each key once, and appends it to ``out`` as parquet; called again it goes on from there.
    With ``late``, a time column, keys are remembered ``within`` that time only, which bounds the state; without, for
    ever."""
    if late is not None:
        once = source.withWatermark(late, within).dropDuplicatesWithinWatermark(list(key))
    else:
        once = source.dropDuplicates(list(key))
    return make(once).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def follow(source: DataFrame, key: Sequence[str], order: Sequence[str], folder: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """A table that holds the last line of each key of a log. A batch rewrites only the buckets its keys fall into; each
    is written anew beside the old one, and a table of which is current is the last write, so that a lost executor or a
    repeated batch does no harm: readers use ``current``."""

    def place(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = place(latest(batch, key, order))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        old = current(spark, folder, new.drop("bucket").schema, number)
        every = place(old).where(F.col("bucket").isin(touched)).unionByName(new)
        merged = place(latest(every.drop("bucket"), key, order))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/{number:012d}")
        spark.createDataFrame([(b, number) for b in touched], "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/versions/{number:012d}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, schema, before: int | None = None) -> DataFrame:
    """The table of ``follow``; ``before``: as it was before that batch."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder + "/versions")
    there = fs.getFileSystem(spark._jsc.hadoopConfiguration())
    if not there.exists(fs):
        return spark.createDataFrame([], schema)
    versions = spark.read.schema("bucket int, version long").parquet(f"{folder}/versions/*")
    if before is not None:
        versions = versions.where(F.col("version") < before)
    newest = versions.groupBy("bucket").agg(F.max("version").alias("version")).collect()  # at most one for each bucket
    out = None
    for r in newest:
        got = spark.read.schema(schema).parquet(f"{folder}/data/{r.version:012d}/bucket={r.bucket}")
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], schema) if out is None else out


def emit(source: DataFrame, write: Callable[[list], None], checkpoint: str, order: Column | None = None, rows: int = 10_000) -> StreamingQuery:
    """Rows of a stream to a writer outside Spark as they come, batch by batch, in ``order`` within a batch, at most
    ``rows`` in the driver at a time; a last call with an empty list says that a batch is done."""

    def step(batch: DataFrame, _: int) -> None:
        held: list = []
        for r in (batch.orderBy(order) if order is not None else batch).toLocalIterator():
            held.append(r)
            if len(held) == rows:
                write(held)
                held = []
        if held:
            write(held)
        write([])

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Calls ``tell`` with {"progress": rows so far} after each batch and {"done": True} at the end."""

    def __init__(self, tell: Callable[[dict], None]) -> None:
        self.tell, self.rows, self.since = tell, 0, time.monotonic()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.tell({"progress": 0})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows
        self.tell({"progress": self.rows})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tell({"done": True, "progress": self.rows})
