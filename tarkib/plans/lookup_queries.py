"""Queries over lookups: tiers, fall-through by column, context, phrases and whole transliterated texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chars as C
from ..functions import letters, normalize, roman
from ..operators import lookup, sets, votes
from .registry import query, table
from .text_queries import KEYS_SQL, P, RUN, TOKENS_SQL, key_counts

COLUMNS = ("devanagari", "roman")


def _dictionary(spark: SparkSession, d: str, tiers: str, key: str = "scheme") -> DataFrame:
    made = {"scheme": normalize.scheme_key, "rule": normalize.rule_key}[key]
    rows = table(spark, d, "dictionary").where(F.col("tier").isin(*tiers) & F.col("urdu").isNotNull())
    return rows.select(made(F.col("urdu")).alias("key"), F.col("deva").alias("devanagari"), F.col("plain").alias("roman"), F.col("rekhta").alias("roman_marked"))


def _learned(spark: SparkSession, d: str, key: str = "scheme") -> DataFrame:
    """(key, devanagari, roman): word rows of the training data, the heaviest target of each word, the earliest of equal
    ones; the Roman of words that only have Devanagari is NULL."""
    made = {"scheme": normalize.scheme_key, "rule": normalize.rule_key}[key]
    rows = table(spark, d, "train").where("task = 'word' AND src <> '' AND tgt <> '' AND NOT contains(src, ' ')").select("train_id", "src", "tgt", "weight").distinct()
    keyed = rows.withColumn("key", made(F.col("src"))).where("key <> ''")
    best = votes.majority(votes.weighted(keyed, ["key"], "tgt", F.col("weight"), "train_id"), ["key"], "tgt")
    return best.select("key", F.col("tgt").alias("devanagari"), F.lit(None).cast("string").alias("roman"))


def _tables(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    a, b = (_dictionary(spark, d, t).drop("roman_marked") for t in ("A", "BC"))
    return [("curated", a), ("exact", b), ("lexicon", _learned(spark, d))]


_DICT_SQL = f"SELECT {normalize.scheme_key_sql('urdu')} AS key, deva AS devanagari, plain AS roman, CASE WHEN tier = 'A' THEN 0 ELSE 1 END AS rank FROM dictionary WHERE tier IN ('A', 'B', 'C') AND urdu IS NOT NULL"
_WORDS_SQL = f"SELECT train_id, {normalize.scheme_key_sql('src')} AS key, tgt, weight FROM (SELECT DISTINCT train_id, src, tgt, weight FROM train WHERE task = 'word' AND src <> '' AND tgt <> '' AND weight > 0 AND NOT contains(src, ' '))"
_LEARNED_SQL = f"SELECT key, tgt AS devanagari, CAST(NULL AS VARCHAR) AS roman, 2 AS rank FROM (SELECT key, tgt, row_number() OVER (PARTITION BY key ORDER BY w DESC, first, tgt) AS k FROM (SELECT key, tgt, sum(weight::DECIMAL(18,3)) AS w, min(train_id) AS first FROM ({_WORDS_SQL}) WHERE key <> '' GROUP BY key, tgt)) WHERE k = 1"
_TIERS_SQL = f"SELECT key, devanagari, roman, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, devanagari NULLS FIRST, roman NULLS FIRST) AS k FROM (({_DICT_SQL}) UNION ALL ({_LEARNED_SQL})) WHERE key <> '') WHERE k = 1"
_NAME = "CASE t.rank WHEN 0 THEN 'curated' WHEN 1 THEN 'exact' WHEN 2 THEN 'lexicon' ELSE 'none' END"


@query(f"SELECT w.key, w.n, t.devanagari, t.roman, {_NAME} AS tier FROM (SELECT key, count(*) AS n FROM ({KEYS_SQL}) WHERE key <> '' GROUP BY key) w LEFT JOIN ({_TIERS_SQL}) t ON w.key = t.key")
def tiered_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct word of the documents with the entry of the first tier that has it."""
    return lookup.tiered(key_counts(spark, d), _tables(spark, d), COLUMNS)


@query(f"SELECT w.lang, {_NAME} AS tier, sum(w.n)::BIGINT AS tokens, count(*) AS types FROM (SELECT coalesce(lang, 'none') AS lang, key, count(*) AS n FROM ({KEYS_SQL}) WHERE key <> '' GROUP BY ALL) w LEFT JOIN ({_TIERS_SQL}) t ON w.key = t.key GROUP BY ALL")
def tier_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of the running text of each language each tier reads: tokens and distinct words."""
    counts = key_counts(spark, d, "lang").withColumn("lang", F.coalesce("lang", F.lit("none")))
    got = lookup.tiered(counts, _tables(spark, d), COLUMNS)
    return got.groupBy("lang", "tier").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))


@query(f"SELECT key, n FROM (SELECT key, count(*) AS n FROM ({KEYS_SQL}) WHERE length(key) >= 2 GROUP BY key) WHERE key NOT IN (SELECT key FROM ({_TIERS_SQL})) ORDER BY n DESC, key LIMIT 300")
def oov_rank(spark: SparkSession, d: str) -> DataFrame:
    """The 300 commonest words that no table has: a top-k report."""
    words = key_counts(spark, d).where(F.length("key") >= 2)
    known = lookup.merged(_tables(spark, d), COLUMNS)
    return sets.without(words, known, "key").orderBy(F.desc("n"), "key").limit(300).select("key", "n")


@query(
    f"WITH w AS (SELECT DISTINCT item_id, {normalize.line_key_sql('urdu')} AS key FROM translit_items WHERE urdu IS NOT NULL), l AS (SELECT {normalize.line_key_sql('urdu')} AS key, min(deva) AS devanagari, min(rich) AS roman FROM test WHERE urdu IS NOT NULL GROUP BY 1), "
    f"t AS (SELECT {normalize.line_key_sql('src')} AS key, min(tgt) AS devanagari FROM train WHERE task IN ('word', 'line') AND src <> '' GROUP BY 1), r AS (SELECT {normalize.line_key_sql('src')} AS key, min(tgt) AS roman FROM train WHERE task = 'casual' AND src <> '' GROUP BY 1), "
    f"x AS (SELECT {normalize.line_key_sql('urdu')} AS key, min(deva) AS devanagari, min(plain) AS roman FROM dictionary WHERE urdu IS NOT NULL GROUP BY 1) "
    "SELECT w.item_id, w.key, coalesce(l.devanagari, t.devanagari, x.devanagari) AS devanagari, coalesce(l.roman, r.roman, x.roman) AS roman, "
    "CASE WHEN l.devanagari IS NOT NULL THEN 'verbatim' WHEN t.devanagari IS NOT NULL THEN 'trained' WHEN x.devanagari IS NOT NULL THEN 'words' END AS devanagari_from, "
    "CASE WHEN l.roman IS NOT NULL THEN 'verbatim' WHEN r.roman IS NOT NULL THEN 'trained' WHEN x.roman IS NOT NULL THEN 'words' END AS roman_from "
    "FROM w LEFT JOIN l USING (key) LEFT JOIN t USING (key) LEFT JOIN r USING (key) LEFT JOIN x USING (key)"
)
def per_column_fallthrough(spark: SparkSession, d: str) -> DataFrame:
    """Items read by whole verbatim lines, training rows, then the dictionary, each script by itself."""

    def keyed(name: str, urdu: str, **columns: str) -> DataFrame:
        rows = table(spark, d, name).where(f"{urdu} IS NOT NULL AND {urdu} <> ''").withColumn("key", normalize.line_key(F.col(urdu)))
        return rows.select("*", *[F.expr(v).alias(k) for k, v in columns.items()]).groupBy("key").agg(*[F.min(k).alias(k) for k in columns])

    tables = [
        ("verbatim", keyed("test", "urdu", devanagari="deva", roman="rich")),
        ("trained", keyed("train", "src", devanagari="if(task IN ('word', 'line'), tgt, NULL)", roman="if(task = 'casual', tgt, NULL)")),
        ("words", keyed("dictionary", "urdu", devanagari="deva", roman="plain")),
    ]
    words = table(spark, d, "translit_items").where("urdu IS NOT NULL").select("item_id", normalize.line_key(F.col("urdu")).alias("key")).distinct()
    return lookup.fallen_through(words, tables, COLUMNS)


# --- context ----------------------------------------------------------------------------------------
_END = f"[{C.SENTENCE_ENDS[:-1]}\\n]"
_SENTENCE_SQL = f"""WITH t AS (SELECT doc_id, pos, tok, regexp_full_match(tok, '{RUN}') AS is_word FROM ({TOKENS_SQL})),
p AS (SELECT *, regexp_extract(tok, '^[{P}]*') AS prefix, CASE WHEN regexp_full_match(tok, '[{P}]+') THEN '' ELSE regexp_extract(tok, '[{P}]*$') END AS suffix, regexp_replace(tok, '^[{P}]+|[{P}]+$', '', 'g') AS core FROM t),
b AS (SELECT *, CASE WHEN is_word THEN regexp_matches(prefix, '{_END}') ELSE regexp_matches(tok, '{_END}') END AS before, is_word AND regexp_matches(suffix, '{_END}') AS after FROM p),
s AS (SELECT *, sum(before::INT) OVER (PARTITION BY doc_id ORDER BY pos) + coalesce(sum(after::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM b),
w AS (SELECT doc_id, pos, sentence, core AS word FROM s WHERE is_word AND core <> ''),
c AS (SELECT doc_id, pos, sentence, word, lag(word) OVER i AS prev, lead(word) OVER i AS next, coalesce(max((word = 'نے')::INT) OVER (PARTITION BY doc_id, sentence ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS ne_before FROM w WINDOW i AS (PARTITION BY doc_id, sentence ORDER BY pos))"""


@query(_SENTENCE_SQL + " SELECT doc_id, pos, sentence::BIGINT AS sentence, word, prev, next FROM c")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    """Words with their neighbours, none across the end of a sentence."""
    return lookup.sentence_words(table(spark, d, "documents"), "doc_id", "text").withColumn("sentence", F.col("sentence").cast("long"))


@query(_SENTENCE_SQL + " SELECT doc_id, pos, word, ne_before FROM c WHERE word IN ('کیا', 'نے') OR ne_before")
def running_flag(spark: SparkSession, d: str) -> DataFrame:
    """Words after the ergative mark in their sentence, and the words it decides about."""
    words = lookup.with_homographs(lookup.sentence_words(table(spark, d, "documents"), "doc_id", "text"), "doc_id")
    return words.where("word IN ('کیا', 'نے') OR ne_before").select("doc_id", "pos", "word", "ne_before")


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + ")"


_RULES = [
    (f"word = 'میں' AND (prev IS NULL OR prev IN {_in(lookup.I_AFTER)} OR next IN {_in(lookup.I_BEFORE)})", "मैं main mai~"),
    (f"word = 'کیا' AND prev IS NOT NULL AND (next IN {_in(lookup.PASSIVE)} OR (ne_before AND (next IS NULL OR next IN {_in(lookup.PERFECT)})))", "किया kiya kiyā"),
    (f"word = 'بن' AND next IN {_in(lookup.VERBAL)}", "बन ban ban"),
    (f"word = 'سو' AND next IN {_in(lookup.VERBAL)}", "सो so so"),
    (f"word = 'جلد' AND next IN {_in(lookup.SOON + lookup.VERBAL)}", "जल्द jald jald"),
    (f"word = 'گر' AND next IN {_in(lookup.VERBAL + lookup.FALLING)}", "गिर gir gir"),
    (f"word = 'کل' AND next IN {_in(lookup.TOTAL)}", "कुल kul kul"),
    ("word = 'کل'", "कल kal kal"),
]


def _rules_sql(i: int) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{r.split(' ')[i]}'" for c, r in _RULES) + " END"


@query(_SENTENCE_SQL + f" SELECT * FROM (SELECT doc_id, pos, word, {_rules_sql(0)} AS devanagari, {_rules_sql(1)} AS plain, {_rules_sql(2)} AS rich FROM c) WHERE devanagari IS NOT NULL")
def homographs(spark: SparkSession, d: str) -> DataFrame:
    """Homographs that their sentence decides, with the reading."""
    words = lookup.with_homographs(lookup.sentence_words(table(spark, d, "documents"), "doc_id", "text"), "doc_id")
    return words.where("reading IS NOT NULL").select("doc_id", "pos", "word", "reading.*")


# --- phrases, merges, overlays ----------------------------------------------------------------------
@query()
def phrase_longest(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary and training phrases of up to four words found in the documents, the longest first (no SQL twin: which
    of the overlapping ones stand is decided along the line; tested against a plain loop)."""
    words = lookup.sentence_words(table(spark, d, "documents"), "doc_id", "text")
    numbered = words.select("doc_id", "sentence", "pos", normalize.scheme_key(F.col("word")).alias("word"))
    numbered = numbered.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id", "sentence").orderBy("pos")) - 1)
    phrases = table(spark, d, "train").where("src <> ''").select(normalize.phrase_key(F.col("src")).alias("phrase")).unionByName(table(spark, d, "dictionary").select(normalize.phrase_key(F.col("urdu")).alias("phrase")))
    return lookup.longest_phrases(numbered.select("doc_id", "sentence", "pos", "word"), phrases.where("phrase <> ''"), ["doc_id", "sentence"])


@query(f"SELECT key, devanagari, roman, CASE rank WHEN 0 THEN 'curated' WHEN 1 THEN 'exact' ELSE 'lexicon' END AS tier FROM ({_TIERS_SQL})")
def lexicon_merge(spark: SparkSession, d: str) -> DataFrame:
    """All tables as one, the reviewed entries over the learned ones."""
    return lookup.merged(_tables(spark, d), COLUMNS)


#: Fixes as a reviewer writes them: keep, drop, replace, add.
FIXES = [("کا", "काा", "."), ("کی", "-", "."), ("میں", ".", "mey"), ("نیالفظ", "नया", "naya")]
_FIXES_SQL = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in FIXES)


@query(f"SELECT coalesce(d.urdu, f.urdu) AS urdu, CASE WHEN coalesce(f.deva, '.') = '.' THEN d.deva ELSE f.deva END AS deva, CASE WHEN coalesce(f.plain, '.') = '.' THEN d.plain ELSE f.plain END AS plain FROM (SELECT urdu, deva, plain FROM dictionary WHERE urdu IS NOT NULL) d FULL OUTER JOIN (VALUES {_FIXES_SQL}) f(urdu, deva, plain) ON d.urdu = f.urdu WHERE coalesce(f.deva, '.') <> '-' AND CASE WHEN coalesce(f.deva, '.') = '.' THEN d.deva ELSE f.deva END IS NOT NULL AND CASE WHEN coalesce(f.plain, '.') = '.' THEN d.plain ELSE f.plain END IS NOT NULL")
def fixes_overlay(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary with a few fixes laid over it."""
    draft = table(spark, d, "dictionary").where("urdu IS NOT NULL").select("urdu", "deva", "plain")
    return sets.overlaid(draft, spark.createDataFrame(FIXES, "urdu string, deva string, plain string"), "urdu", ["deva", "plain"])


@query("SELECT item_id, provider_id, arg_max(devanagari, (created_at, result_id)) AS devanagari, max(created_at) AS created_at FROM (SELECT DISTINCT item_id, provider_id, result_id, created_at, coalesce(devanagari, '') AS devanagari FROM translit_results) GROUP BY item_id, provider_id")
def corrections_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The latest answer of each provider to each item: a log in which the last line wins."""
    log = table(spark, d, "translit_results").select("item_id", "provider_id", "result_id", "created_at", F.coalesce("devanagari", F.lit("")).alias("devanagari")).distinct()
    return sets.latest(log, ["item_id", "provider_id"], ["created_at", "result_id"]).select("item_id", "provider_id", "devanagari", "created_at")


# --- whole texts ------------------------------------------------------------------------------------
@query()
def transliterate_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document in Devanagari, plain and marked Roman: tiers first, letters for the rest, line breaks kept (no SQL
    twin: letter rules; goldens in the tests)."""
    a, b = (_dictionary(spark, d, t, "rule") for t in ("A", "BC"))
    learned = _learned(spark, d, "rule").join(a.unionByName(b).select("key"), "key", "left_anti").select("key", "devanagari")
    read = learned.select("key", "devanagari", letters.read_letters("key").alias("r")).select("key", "devanagari", F.col("r.roman").alias("roman"), F.col("r.roman_marked").alias("roman_marked"))
    return lookup.transliterate(table(spark, d, "documents"), "doc_id", "text", [("curated", a), ("exact", b), ("lexicon", read)])


@query()
def letter_readings(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary's words read by letters alone, beside the reviewed readings."""
    rows = table(spark, d, "dictionary").where("urdu IS NOT NULL").select("urdu", "deva", "plain", normalize.rule_key(F.col("urdu")).alias("key"))
    return rows.withColumn("r", letters.read_letters("key")).select("urdu", "deva", "plain", "r.devanagari", "r.roman", "r.roman_marked")


@query()
def article_forms(spark: SparkSession, d: str) -> DataFrame:
    """Words with the Arabic article read from the word without it, at the start and after a word."""
    entries = lookup.merged([("dictionary", _dictionary(spark, d, "ABC"))], ("devanagari", "roman", "roman_marked"))
    words = key_counts(spark, d).where("startswith(key, 'ال') AND length(key) >= 4").select("key", F.substring("key", 3, 10_000).alias("rest"))
    met = words.join(entries.withColumnRenamed("key", "rest"), "rest")
    return met.select("key", *roman_article("key", "devanagari", "roman", "roman_marked"))


def roman_article(key: str, deva: str, plain: str, marked: str) -> list:
    kind = T.StructType([T.StructField(n, T.StringType()) for n in ("devanagari", "plain", "marked")])

    def made(after: bool):
        @F.pandas_udf(kind)
        def run(k: pd.Series, d: pd.Series, p: pd.Series, m: pd.Series) -> pd.DataFrame:
            rows = [roman.article(a, (b, c, e), after) or (None, None, None) for a, b, c, e in zip(k, d, p, m, strict=True)]
            return pd.DataFrame(rows, columns=kind.names, dtype=object)

        return run(key, deva, plain, marked)

    return [made(False).alias("first"), made(True).alias("after_word")]


