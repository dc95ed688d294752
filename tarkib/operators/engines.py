"""Engines as data: a registry, runs in which a failure is a row, pickers and the batch matrix."""

from __future__ import annotations

import importlib
import pkgutil
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as OutOfTime
from dataclasses import dataclass, field
from types import ModuleType
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPABILITIES = ("ocr", "translit")


@dataclass(frozen=True)
class Engine:
    """One way to do a step. ``call`` takes a text (or bytes) and gives a value; ``ready`` says whether it can run."""

    name: str
    capability: str
    label: str
    call: Callable[[Any], str]
    kind: str = "offline"
    note: str = ""
    ready: Callable[[], bool] = field(default=lambda: True)

    def __post_init__(self) -> None:
        if self.capability not in CAPABILITIES:
            raise ValueError(f"capability: one of {CAPABILITIES}")


class Registry:
    """Engines by capability and name; a later one of the same name replaces the earlier."""

    def __init__(self) -> None:
        self._engines: dict[tuple[str, str], Engine] = {}

    def add(self, engine: Engine) -> Engine:
        self._engines[engine.capability, engine.name] = engine
        return engine

    def get(self, capability: str, name: str) -> Engine:
        return self._engines[capability, name]

    def engines(self, capability: str | None = None) -> list[Engine]:
        return [e for e in self._engines.values() if capability in (None, e.capability)]

    def discover(self, package: ModuleType) -> Registry:
        """Adds the ``ENGINE`` of every module of a package. Modules that begin with an underscore are passed over, as
        are those that can't be imported."""
        for m in pkgutil.walk_packages(package.__path__, package.__name__ + "."):
            if m.name.rpartition(".")[2].startswith("_"):
                continue
            try:
                found = getattr(importlib.import_module(m.name), "ENGINE", None)
            except ImportError:
                continue
            if isinstance(found, Engine):
                self.add(found)
        return self

    def frame(self, spark) -> DataFrame:
        """(provider_id, capability, label, kind, note, available)."""

        def ready(e: Engine) -> bool:
            try:
                return bool(e.ready())
            except Exception:  # noqa: BLE001 - one that can't even tell isn't there
                return False

        rows = [(e.name, e.capability, e.label, e.kind, e.note, ready(e)) for e in self.engines()]
        return spark.createDataFrame(rows, "provider_id string, capability string, label string, kind string, note string, available boolean")


RESULT = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("ms", T.IntegerType()), T.StructField("value", T.StringType())])


def attempt(call: Callable[[Any], str], value: Any) -> tuple[bool, str | None, int, str | None]:
    start = time.monotonic()
    try:
        out: tuple = (True, None, call(value))
    except Exception as e:  # noqa: BLE001 - a failure is data
        out = (False, f"{type(e).__name__}: {e}", None)
    return out[0], out[1], int((time.monotonic() - start) * 1000), out[2]


def as_udf(engine: Engine, timeout: float | None = None):
    """An Arrow UDF text to struct<ok, error, ms, value> that never raises. A call that takes longer than ``timeout``
    seconds is given up and is an error row."""

    @F.pandas_udf(RESULT)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            if timeout is None:
                rows.append(attempt(engine.call, x))
                continue
            pool = ThreadPoolExecutor(1)
            try:
                rows.append(pool.submit(attempt, engine.call, x).result(timeout))
            except OutOfTime:
                rows.append((False, f"timed out after {timeout:.0f}s", int(timeout * 1000), None))
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
        return pd.DataFrame(rows, columns=RESULT.names, dtype=object)

    return run


def run_all(df: DataFrame, column: str, engines: Registry, capability: str, names: Sequence[str], timeout: float | None = None) -> DataFrame:
    """``df`` with, for each row and each named engine, (provider_id, position, ok, error, ms, value); an engine that
    isn't there gives 'unknown provider'. ``position`` is the order asked for."""
    out = None
    for i, name in enumerate(names):
        try:
            result = as_udf(engines.get(capability, name), timeout)(F.col(column))
        except KeyError:
            result = F.struct(F.lit(False).alias("ok"), F.lit("unknown provider").alias("error"), F.lit(0).alias("ms"), F.lit(None).cast("string").alias("value"))
        got = df.select("*", F.lit(name).alias("provider_id"), F.lit(i).alias("position"), result.alias("_r")).select(*df.columns, "provider_id", "position", "_r.*")
        out = got if out is None else out.unionByName(got)
    return out


def as_completed(df: DataFrame) -> Iterator:
    """Rows as their partitions are done, one partition in the driver at a time."""
    return df.toLocalIterator(prefetchPartitions=True)


def picker(providers: DataFrame, available: Column, curated: Sequence[str] | None = None) -> DataFrame:
    """Engines of each capability in the order shown: the curated ones in their own order, where a capability has any;
    else all, those that can run first, then by label without case. ``place`` counts from 1."""
    from pyspark.sql import Window

    rows = providers.withColumn("available", available)
    listed = F.array_position(F.array(*[F.lit(x) for x in curated or []]).cast("array<string>"), F.col("provider_id"))
    rows = rows.withColumn("_at", listed)
    has = F.max(F.col("_at")).over(Window.partitionBy("capability")) > 0
    kept = rows.withColumn("_curated", has).where(~F.col("_curated") | (F.col("_at") > 0))
    order = Window.partitionBy("capability").orderBy(F.when(F.col("_curated"), F.col("_at")).otherwise(0), F.desc("available"), F.lower("label"), "provider_id")
    return kept.withColumn("place", F.row_number().over(order)).drop("_at", "_curated")


def batch_matrix(ocr: DataFrame, translit: DataFrame) -> DataFrame:
    """(file, ocr_engine, urdu, translit_engine, devanagari, roman, roman_diacritic, ms, error): every OCR result with
    every transliteration of its text; a failed or empty result, or one nobody transliterated, is a row by itself.

    ``ocr``: (file, ocr_engine, ok, urdu, ms, error); ``translit``: (file, ocr_engine, translit_engine, ok, devanagari,
    roman, roman_diacritic, ms, error). ms adds up."""
    t = translit.select("file", "ocr_engine", "translit_engine", "devanagari", "roman", "roman_diacritic", F.col("ms").alias("_ms"), F.col("error").alias("_error"))
    usable = F.col("ok") & (F.coalesce("urdu", F.lit("")) != "")
    whole = ocr.where(usable).join(t, ["file", "ocr_engine"], "left")
    base = ocr.where(~F.coalesce(usable, F.lit(False)))
    for c in ("translit_engine", "devanagari", "roman", "roman_diacritic", "_error"):
        base = base.withColumn(c, F.lit(None).cast("string"))
    base = base.withColumn("_ms", F.lit(0))
    out = whole.unionByName(base.select(*whole.columns))
    return out.select("file", "ocr_engine", "urdu", "translit_engine", "devanagari", "roman", "roman_diacritic", (F.col("ms") + F.coalesce("_ms", F.lit(0))).alias("ms"), F.coalesce("_error", "error").alias("error"))
