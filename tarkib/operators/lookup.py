"""Looking words up: tiers, columns that fall through, context, neighbours' joins and longest phrases.

All lookups are joins on distinct keys. No broadcast is asked for: tables may grow, and Spark itself broadcasts a
side it has measured to be small enough (``spark.sql.autoBroadcastJoinThreshold``, adaptive execution).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chars as C
from ..functions import letters, normalize, text


def merged(tables: Sequence[tuple[str, DataFrame]], columns: Sequence[str], key: str = "key") -> DataFrame:
    """(key, columns..., tier): tables of ``key`` and ``columns`` in one, the first that has a key winning. Within a
    table the least row wins, so that the result doesn't depend on order. NULL and '' keys are left out."""
    out = None
    for rank, (name, df) in enumerate(tables):
        got = df.select(F.col(key), F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("tier"), *[F.col(c) for c in columns]).alias("entry"))
        out = got if out is None else out.unionByName(got)
    best = out.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min("entry").alias("entry"))
    return best.select(key, *[F.col(f"entry.{c}") for c in columns], "entry.tier")


def tiered(words: DataFrame, tables: Sequence[tuple[str, DataFrame]], columns: Sequence[str], key: str = "key", none: str = "none") -> DataFrame:
    """``words`` (with ``key``) and the columns and ``tier`` of the first table that has it; ``none`` where none has.
    Every row stays; a NULL key finds nothing. One join, however many tiers."""
    found = merged(tables, columns, key)
    return words.join(found, key, "left").withColumn("tier", F.coalesce("tier", F.lit(none)))


def fallen_through(words: DataFrame, tables: Sequence[tuple[str, DataFrame]], columns: Sequence[str], key: str = "key") -> DataFrame:
    """As ``tiered``, but each column by itself from the first table with a value there: NULL is no data and falls
    through, '' is a value and stays. ``<column>_from`` names the table."""
    packed = []
    for rank, (name, df) in enumerate(tables):
        packed.append(df.select(F.col(key), *[F.when(F.col(c).isNotNull(), F.struct(F.lit(rank).alias("rank"), F.col(c).alias("value"), F.lit(name).alias("name"))).alias(c) for c in columns]))
    every = packed[0]
    for df in packed[1:]:
        every = every.unionByName(df)
    best = every.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(c).alias(c) for c in columns])
    best = best.select(key, *[F.col(f"{c}.value").alias(c) for c in columns], *[F.col(f"{c}.name").alias(f"{c}_from") for c in columns])
    return words.join(best, key, "left")


# --- tokens in their sentences --------------------------------------------------------------------
def tokens(df: DataFrame, row_id: str, column: str, first: str = "pos") -> DataFrame:
    """(id, pos, tok, is_word): the stream of a text, nothing lost; NULL and '' texts have no tokens."""
    return df.select(F.col(row_id), F.posexplode(text.stream(F.col(column))).alias(first, "tok")).withColumn("is_word", F.col("tok").rlike(f"^{C.URDU_RUN}$"))


def sentence_words(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """(id, pos, sentence, word, prev, next): the words of each text with their neighbours in the sentence; no
    neighbour across a sentence mark or line break, wherever the mark stands: in the gap or at the word's edges."""
    t = tokens(df, row_id, column).withColumn("p", text.peel(F.col("tok")))
    end = f"[{C.SENTENCE_ENDS}]"
    by = Window.partitionBy(row_id).orderBy("pos")
    before = F.when(F.col("is_word"), F.col("p.prefix").rlike(end)).otherwise(F.col("tok").rlike(end)).cast("int")
    after = F.when(F.col("is_word"), F.col("p.suffix").rlike(end)).otherwise(False).cast("int")
    t = t.withColumn("sentence", F.sum(before).over(by) + F.coalesce(F.sum(after).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    words = t.where(F.col("is_word") & (F.col("p.core") != "")).select(row_id, "pos", "sentence", F.col("p.core").alias("word"))
    inside = Window.partitionBy(row_id, "sentence").orderBy("pos")
    return words.withColumn("prev", F.lag("word").over(inside)).withColumn("next", F.lead("word").over(inside))


# --- Fixed values: homographs and the neighbours that decide them -----------------------------------
PASSIVE = "گیا گئی گئے گیی جاتا جاتی جاتے جائے جا جانا".split()
PERFECT = "ہے ہیں تھا تھی تھے ہوگا ہو".split()
VERBAL = [*PASSIVE, *"جاؤ جاؤں جائیں رہا رہی رہے رہیں سکتا سکتی سکتے سکا سکی سکے کر چکا چکی چکے گا گی گے".split()]
SOON = "ہی از سے بازی ہو ہوا ہوئی ہوئے ہوں سو اٹھ آ جا چل کر پہنچ لوٹ واپس شروع ختم مل بن".split()
FALLING = "پڑا پڑی پڑے پڑتا پڑتی پڑتے جائے جاتا جاتی جاتے".split()
TOTAL = "آبادی تعداد رقبہ رقبے ملا رقم مجموعی وقتی جماعتی تعدا لاگت ووٹ ووٹوں نمبر نمبروں اثاثے آمدنی خرچ مدت لمبائی اراکین ارکان افراد سیٹوں".split()
I_AFTER = "اور کہ جب اگر تو مگر لیکن پھر کیونکہ بلکہ اب ہاں جو".split()
I_BEFORE = "نے ہوں خود".split()


def homographs(word: Column, prev: Column, nxt: Column, first: Column, ne_before: Column) -> Column:
    """struct<devanagari, plain, rich> of a homograph that its sentence decides, else NULL. ``first``: first word of
    the sentence; ``ne_before``: the ergative mark stood earlier in it."""

    def entry(*r: str) -> Column:
        return F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("devanagari", "plain", "rich"), strict=True)])

    def near(c: Column, words: list[str]) -> Column:
        return F.coalesce(c.isin(*words), F.lit(False))

    perfect = ne_before & (nxt.isNull() | near(nxt, PERFECT))
    return (
        F.when((word == "میں") & (first | near(prev, I_AFTER) | near(nxt, I_BEFORE)), entry("मैं", "main", "mai~"))
        .when((word == "کیا") & ~first & (near(nxt, PASSIVE) | perfect), entry("किया", "kiya", "kiyā"))
        .when((word == "بن") & near(nxt, VERBAL), entry("बन", "ban", "ban"))
        .when((word == "سو") & near(nxt, VERBAL), entry("सो", "so", "so"))
        .when((word == "جلد") & (near(nxt, SOON) | near(nxt, VERBAL)), entry("जल्द", "jald", "jald"))
        .when((word == "گر") & (near(nxt, VERBAL) | near(nxt, FALLING)), entry("गिर", "gir", "gir"))
        .when((word == "کل") & near(nxt, TOTAL), entry("कुल", "kul", "kul"))
        .when(word == "کل", entry("कल", "kal", "kal"))
    )


def with_homographs(words: DataFrame, row_id: str) -> DataFrame:
    """``sentence_words`` with ``first``, ``ne_before`` and the reading of homographs."""
    inside = Window.partitionBy(row_id, "sentence").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max((F.col("word") == "نے").cast("int")).over(inside), F.lit(0)) == 1
    out = words.withColumn("first", F.col("prev").isNull()).withColumn("ne_before", seen)
    return out.withColumn("reading", homographs(*[F.col(c) for c in ("word", "prev", "next", "first", "ne_before")]))


def context_readings(words: DataFrame, context: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``words`` (word, prev, next) with each column's reading by its neighbours. ``context``: (side L or R, a, b,
    columns); L is keyed by the word before, R by the word after, which wins column by column."""
    left = context.where("side = 'L'").select(F.col("a").alias("prev"), F.col("b").alias("word"), *[F.col(c).alias(f"_l_{c}") for c in columns])
    right = context.where("side = 'R'").select(F.col("a").alias("word"), F.col("b").alias("next"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    out = words.join(left, ["prev", "word"], "left").join(right, ["word", "next"], "left")
    return out.select(*words.columns, *[F.coalesce(f"_r_{c}", f"_l_{c}").alias(c) for c in columns])


def pair_joins(words: DataFrame, joins: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``words`` (word, next) with each script's joiner to the next word. A script without data takes another's, in
    the order of ``columns``, but never +, which needs its own merged spelling; no data at all gives NULL."""
    fill = F.coalesce(*[F.when(F.col(f"_j_{c}") != "+", F.col(f"_j_{c}")) for c in columns])
    table = joins.select(F.col("a").alias("word"), F.col("b").alias("next"), *[F.col(c).alias(f"_j_{c}") for c in columns])
    return words.join(table, ["word", "next"], "left").select(*words.columns, *[F.coalesce(F.col(f"_j_{c}"), fill).alias(c) for c in columns])


# --- phrases --------------------------------------------------------------------------------------
def longest_phrases(words: DataFrame, phrases: DataFrame, group: Sequence[str], most: int = 4) -> DataFrame:
    """(group..., pos, n, phrase): phrases of up to ``most`` words found in lines, from the left, the longest first,
    none within another. ``words``: (group..., pos counted up by one, word); ``phrases``: (phrase) with single blanks.

    Candidates come from one join; which of them stand is decided along each line, a bounded group."""
    by = Window.partitionBy(*group).orderBy("pos")
    grams = words
    for n in range(1, most):
        grams = grams.withColumn(f"_w{n}", F.lead("word", n).over(by))
    options = F.array(*[F.struct(F.lit(n).alias("n"), F.array_join(F.array("word", *[f"_w{k}" for k in range(1, n)]), " ").alias("phrase"), (F.lit(True) if n == 1 else F.col(f"_w{n - 1}").isNotNull()).alias("whole")) for n in range(1, most + 1)])
    grams = grams.select(*group, "pos", F.explode(options).alias("g")).where("g.whole").select(*group, "pos", "g.n", "g.phrase")
    hits = grams.join(phrases.select("phrase").distinct(), "phrase", "left_semi")
    longest = hits.groupBy(*group, "pos").agg(F.max("n").alias("n"), F.max_by("phrase", "n").alias("phrase"))
    packed = longest.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("pos", "n", "phrase"))).alias("hits"))
    # a hit that begins inside the last one kept is passed over
    start = F.struct(F.lit(-1).alias("end"), F.expr("cast(array() as array<struct<pos:int,n:int,phrase:string>>)").alias("kept"))
    step = F.aggregate(
        "hits",
        start,
        lambda a, h: F.when(h["pos"] < a["end"], a).otherwise(F.struct((h["pos"] + h["n"]).cast("int").alias("end"), F.concat(a["kept"], F.array(h)).alias("kept"))),
        lambda a: a["kept"],
    )
    return packed.select(*group, F.explode(step).alias("h")).select(*group, "h.*")


# --- whole texts ----------------------------------------------------------------------------------
READ = ("devanagari", "roman", "roman_marked")


def _joined(parts: DataFrame, row_id: str, columns: Iterable[str]) -> DataFrame:
    packed = parts.groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("p"))

    def texts(c: str) -> Column:
        return F.array_join(F.transform("p", lambda x: x[c]), "").alias(c)

    return packed.select(row_id, *[texts(c) for c in columns])


def transliterate(df: DataFrame, row_id: str, column: str, tables: Sequence[tuple[str, DataFrame]], oov: Column | None = None) -> DataFrame:
    """(id, devanagari, roman, roman_marked) of every text: words through the tiers, the rest by ``oov``, a column
    over ``key`` that gives a struct of the three (letter rules by default); punctuation by script, all else as it
    is. ``tables``: (key by ``rule_key``, the three columns); a NULL among them is made from the others or by ``oov``.
    NULL texts give NULL, '' gives ''.

    Each distinct word is looked up and read once, then joined back."""
    clean = df.select(F.col(row_id), normalize.rule_text(F.col(column)).alias("_t"))
    t = tokens(clean, row_id, "_t").withColumn("p", text.peel(F.col("tok"))).withColumn("key", F.when(F.col("is_word") & (F.col("p.core") != ""), F.col("p.core")))
    keys = t.where("key IS NOT NULL").select("key").distinct()
    known = tiered(keys, tables, READ)
    read = letters.read_letters("key") if oov is None else oov
    whole = F.col("devanagari").isNotNull() & F.col("roman").isNotNull() & F.col("roman_marked").isNotNull()
    hit = known.where(whole).select("key", *READ)
    partly = known.where(~whole).select("key", *READ, read.alias("r"), marked_by_rule("key", "devanagari", "roman")["roman_marked"].alias("m"))
    filled = {"devanagari": F.coalesce("devanagari", "r.devanagari"), "roman": F.coalesce("roman", "r.roman"), "roman_marked": F.coalesce("roman_marked", "m", "r.roman_marked")}
    out = t.join(hit.unionByName(partly.select("key", *[v.alias(c) for c, v in filled.items()])), "key", "left")

    def shown(c: str) -> Column:
        table = C.PUNCT_DEVA if c == "devanagari" else C.PUNCT_ROMAN
        word = F.concat(text.punct(F.col("p.prefix"), table), F.coalesce(F.col(c), F.lit("")), text.punct(F.col("p.suffix"), table))
        return F.when(F.col("is_word"), word).otherwise(F.col("tok")).alias(c)

    done = _joined(out.select(row_id, "pos", *[shown(c) for c in READ]), row_id, READ)
    empty = F.when(F.col("_t").isNotNull(), F.lit(""))
    return clean.join(done, row_id, "left").select(row_id, *[F.coalesce(F.col(c), empty).alias(c) for c in READ])


_LINE = T.StructType([T.StructField(c, T.StringType()) for c in READ])


@F.pandas_udf(_LINE)
def marked_by_rule(urdu: pd.Series, deva: pd.Series, roman: pd.Series) -> pd.DataFrame:
    """Entries of a table without marked Roman: made from the plain one."""
    return pd.DataFrame({"devanagari": deva, "roman": roman, "roman_marked": [letters.mark_curated(u, r) if isinstance(u, str) and isinstance(r, str) else None for u, r in zip(urdu, roman, strict=True)]})
