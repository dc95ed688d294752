"""Problem 4: one consistent form of texts that look alike.

Method: quick check first. A row none of whose characters is unstable never leaves the JVM; of the other rows
only the unstable stretches, widened to their boundaries, are normalised and spliced back (``common.canon``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LETTER, canon_udf, cut, java_class, stable_points


def unstable() -> str:
    """Java regex of what may change or join in the canonical form. What isn't known to be stable counts."""
    return f"[^{java_class(stable_points())}]|(?<![{_LETTER}])\\x{{93C}}|(?<![\\x{{904}}-\\x{{939}}\\x{{93C}}])\\x{{94D}}"


def canonical(text: Column) -> Column:
    """Canonical form of a text column: NULL stays NULL, a blank text gives ''. Any length."""
    stable = F.regexp_replace(F.regexp_replace(text, " {2,}", " "), " *\n *", "\n")
    stable = F.regexp_replace(stable, "^[ \n]+|[ \n]+$", "")
    touched = text.rlike(unstable())
    return F.when(touched, canon_udf(F.when(touched, text))).otherwise(stable)


def unify(df: DataFrame, text: str, into: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of column ``text`` in a new column; all rows and columns stay.
    A column of the name ``into`` that is there already is an error, not overwritten."""
    if into in df.columns:
        raise ValueError(f"column {into} exists")
    return df.withColumn(into, canonical(F.col(f"`{text}`")))


def forms(df: DataFrame, row_id: str, text: str, within: str | None = None) -> DataFrame:
    """(id, g, k, s) of rows whose form has several stored variants: the group, the form and the variant by hash."""
    rows = df.select(
        F.col(f"`{row_id}`").alias("id"),
        F.col(f"`{text}`").alias("text"),
        (F.col(f"`{within}`") if within else F.lit(0)).alias("g"),
    ).where("id IS NOT NULL AND g IS NOT NULL AND text IS NOT NULL")
    keyed = cut(rows.withColumn("c", canonical(F.col("text"))).where("c <> ''").select("id", "g", F.md5(F.encode("c", "UTF-8")).alias("k"), F.md5(F.encode("text", "UTF-8")).alias("s")))
    varied = keyed.groupBy("g", "k").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("g", "k")
    return cut(keyed.join(varied, ["g", "k"], "left_semi").distinct())


def look_alikes(df: DataFrame, row_id: str, text: str, within: str | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts look alike and whose stored values differ.

    ``within``: only pairs with the same, not NULL value of this column. NULL ids, NULL and blank texts take
    no part; a row stored twice counts once. Only stored variants of one form are paired, then expanded by
    their rows, so that copies of one stored value cost nothing.
    """
    members = forms(df, row_id, text, within)
    kinds = members.select("g", "k", "s").distinct()
    pairs = kinds.join(kinds.withColumnRenamed("s", "s2"), ["g", "k"]).where("s <> s2")
    a = members.withColumnRenamed("id", "id_a")
    b = members.select(F.col("id").alias("id_b"), "g", "k", F.col("s").alias("s2"))
    return a.join(pairs, ["g", "k", "s"]).join(b, ["g", "k", "s2"]).where("id_a < id_b").select("id_a", "id_b").distinct()


def form_classes(df: DataFrame, row_id: str, text: str, within: str | None = None) -> DataFrame:
    """(id, class_id, variants): the rows of ``look_alikes`` with the class of their form and how many stored variants it
    has: one row for each, however many pairs there are."""
    members = forms(df, row_id, text, within)
    variants = members.groupBy("g", "k").agg(F.count_distinct("s").alias("variants"))
    return members.join(variants, ["g", "k"]).select("id", F.md5(F.concat_ws("|", F.col("g").cast("string"), "k")).alias("class_id"), "variants")
