"""Queries that build or use the tables of the line engine: drafts, gold words, context and joins of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import candidates, lining, normalize, text
from ..operators import lookup, sequences, sets, votes
from .lookup_queries import _NAME, _TIERS_SQL, COLUMNS, _tables
from .registry import query, table
from .text_queries import KEYS_SQL, key_counts
from .vote_queries import _NEAR_SQL, _answers, _majority_sql, _rows, sql_words, zipped_words


@query(f"SELECT w.key, w.n, t.devanagari, t.roman, {_NAME} AS tier FROM (SELECT key, count(*) AS n FROM ({KEYS_SQL}) WHERE key <> '' GROUP BY key ORDER BY n DESC, key LIMIT 1000) w LEFT JOIN ({_TIERS_SQL}) t ON w.key = t.key")
def draft_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The 1000 commonest words with what the tables say of them, for review: a top-k report."""
    top = key_counts(spark, d).orderBy(F.desc("n"), "key").limit(1000).select("key", "n")
    return lookup.tiered(top, _tables(spark, d), COLUMNS)


_LEX = f"SELECT {normalize.word_key_sql('src')} AS key, min(tgt) AS deva FROM train WHERE task = 'word' AND src <> '' AND tgt <> '' GROUP BY 1"
_DIC = f"SELECT {normalize.word_key_sql('urdu')} AS key, min(deva) AS deva FROM dictionary WHERE urdu <> '' AND deva <> '' GROUP BY 1"


@query(f"SELECT key, coalesce(d.deva, l.deva) AS deva FROM ({_LEX}) l FULL OUTER JOIN ({_DIC}) d USING (key) WHERE key <> '' AND NOT contains(key, ' ') AND NOT contains(coalesce(d.deva, l.deva), ' ') AND key NOT IN (SELECT {normalize.word_key_sql('urdu')} FROM test WHERE urdu IS NOT NULL)")
def gold_words(spark: SparkSession, d: str) -> DataFrame:
    """Single words with their spelling: the dictionary over the training rows, less what is held out."""

    def keyed(rows: DataFrame, urdu: str, deva: str) -> DataFrame:
        return rows.where(f"{urdu} <> '' AND {deva} <> ''").select(normalize.word_key(F.col(urdu)).alias("key"), F.col(deva).alias("deva")).groupBy("key").agg(F.min("deva").alias("deva"))

    both = sets.by_priority([keyed(table(spark, d, "train").where("task = 'word'"), "src", "tgt"), keyed(table(spark, d, "dictionary"), "urdu", "deva")], "key")
    held = table(spark, d, "test").select(normalize.word_key(F.col("urdu")).alias("key"))
    return sets.without(both.where("key <> '' AND NOT contains(key, ' ') AND NOT contains(deva, ' ')"), held, "key")


_CACHE = f"SELECT {normalize.line_key_sql('src')} AS key, min(tgt) AS answer FROM train WHERE task = 'line' AND src IS NOT NULL GROUP BY 1"


@query(f"SELECT t.key, c.answer FROM (SELECT DISTINCT {normalize.line_key_sql('urdu')} AS key FROM test WHERE urdu IS NOT NULL) t LEFT JOIN ({_CACHE}) c USING (key)")
def cached_answers(spark: SparkSession, d: str) -> DataFrame:
    """Distinct lines to score with the answer known for them; NULL ones go to the system, and if it gives none either they
    aren't scored."""
    cache = table(spark, d, "train").where("task = 'line' AND src IS NOT NULL").groupBy(normalize.line_key(F.col("src")).alias("key")).agg(F.min("tgt").alias("answer"))
    lines = table(spark, d, "test").where("urdu IS NOT NULL").select(normalize.line_key(F.col("urdu")).alias("key")).distinct()
    return lines.join(cache, "key", "left")


def _context_sql(a: str, b: str) -> str:
    return _majority_sql(f"{a}, {b}", f"SELECT * FROM ({_NEAR_SQL}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL")


_TEST_SQL = f"SELECT *, lag(word) OVER i AS prev, lead(word) OVER i AS next FROM (SELECT test_id, (generate_subscripts(u, 1) - 1)::INTEGER AS pos, unnest(u) AS word FROM (SELECT test_id, {sql_words('urdu')} AS u FROM test)) WINDOW i AS (PARTITION BY test_id ORDER BY pos)"


def _test_words(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    words = table(spark, d, "test").select("test_id", F.posexplode(text.words(F.col("urdu"))).alias("pos", "word"))
    by = Window.partitionBy("test_id").orderBy("pos")
    return words.withColumn("prev", F.lag("word").over(by)).withColumn("next", F.lead("word").over(by))


@query(f"SELECT test_id, pos, t.word, coalesce(r.reading, l.reading) AS reading FROM ({_TEST_SQL}) t LEFT JOIN ({_context_sql('prev', 'word')}) l ON t.prev = l.prev AND t.word = l.word LEFT JOIN ({_context_sql('word', 'next')}) r ON t.word = r.word AND t.next = r.next")
def context_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Words of the evaluation rows read as next to the same neighbours in the training lines; the word after decides."""
    z = zipped_words(spark, d)
    tables = None
    for side, key in (("L", ["prev", "word"]), ("R", ["word", "next"])):
        v = votes.weighted(z, key, "reading", F.lit(1), "train_id")
        got = votes.majority(v, key, "reading").select(F.lit(side).alias("side"), F.col(key[0]).alias("a"), F.col(key[1]).alias("b"), "reading")
        tables = got if tables is None else tables.unionByName(got)
    return lookup.context_readings(_test_words(spark, d), tables, ["reading"]).select("test_id", "pos", "word", "reading")


@query()
def pair_joins(spark: SparkSession, d: str) -> DataFrame:
    """How neighbours of the evaluation rows are joined in each script, by the training lines (no SQL twin: those are aligned
    by dynamic programming)."""
    rows = _rows(spark, d).select("train_id", text.urdu_tokens(F.col("src")).alias("t"), "task", "tgt")
    out = None
    for script, task in (("deva", "line"), ("roman", "casual")):
        made = rows.where(F.col("task") == task).select("train_id", "t", lining.output_readings(script)("t", "tgt").alias("r")).where("size(r) = size(t)")
        flat = made.select("train_id", F.explode(F.arrays_zip(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))).alias("a"), F.slice("t", 2, 1_000_000).alias("b"), F.transform("r", lambda x: x["joiner"]).alias("j")))).select("train_id", "col.*").toDF("train_id", "a", "b", "j")
        v = votes.weighted(flat.where("b IS NOT NULL"), ["a", "b"], "j", F.lit(1), "train_id")
        got = votes.majority(v, ["a", "b"], "j").select("a", "b", F.col("j").alias(script))
        out = got if out is None else out.join(got, ["a", "b"], "full_outer")
    return lookup.pair_joins(_test_words(spark, d).select("test_id", "pos", "word", "next"), out, ["roman", "deva"])


@query(f"SELECT result_id, (generate_subscripts(d, 1) - 1)::INTEGER AS pos, unnest(u) AS urdu, unnest(d) AS devanagari, unnest(r) AS roman FROM (SELECT DISTINCT t.result_id, {sql_words('i.urdu')} AS u, {sql_words('t.devanagari')} AS d, {sql_words('t.roman')} AS r FROM translit_results t JOIN (SELECT DISTINCT item_id, urdu FROM translit_items) i USING (item_id)) WHERE len(u) = len(d) AND len(u) = len(r)")
def script_lineup(spark: SparkSession, d: str) -> DataFrame:
    """Words of the three scripts side by side, where all have as many."""
    items = table(spark, d, "translit_items").select("item_id", "urdu").distinct()
    rows = table(spark, d, "translit_results").select("result_id", "item_id", "devanagari", "roman").distinct().join(items, "item_id")
    return sets.zipped(rows, ["result_id"], {n: text.words(F.col(n)) for n in ("urdu", "devanagari", "roman")}).distinct()


@query()
def chosen_readings(spark: SparkSession, d: str) -> DataFrame:
    """R readings of the dictionary's words: of the schwa variants the one that its marked Roman and people's spellings back."""
    items = table(spark, d, "translit_items").select("item_id", "urdu").distinct()
    said = _answers(spark, d).join(items, "item_id").groupBy("urdu", "roman").agg(F.count("*").cast("double").alias("w")).groupBy("urdu").agg(F.sort_array(F.collect_list(F.struct("roman", "w"))).alias("votes"))
    words = table(spark, d, "dictionary").where("urdu IS NOT NULL AND deva IS NOT NULL").select("urdu", "deva", "rich")
    return words.join(said, "urdu", "left").select("urdu", "deva", candidates.chosen("deva", "urdu", "rich", "votes").alias("reading"))


@query()
def crop_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each OCR result given to the lines of the quickest result of the page by likeness, each once."""
    rows = table(spark, d, "ocr_results").where("ok AND text IS NOT NULL").select("result_id", "page_id", "text", "ms").distinct()
    best = rows.groupBy("page_id").agg(F.min(F.struct("ms", "result_id", "text")).alias("b")).select("page_id", F.col("b.result_id").alias("ref_id"), F.col("b.text").alias("ref"))
    pairs = rows.join(best, "page_id").where("result_id <> ref_id")
    return pairs.select("result_id", "ref_id", lining.assigned(F.split("text", "\n"), F.split("ref", "\n")).alias("lines"))


@query()
def epoch(spark: SparkSession, d: str) -> DataFrame:
    """A training epoch: so many rows of each task, drawn by a seed (a sampling operator)."""
    rows = table(spark, d, "train").select("train_id", "task", "src", "tgt").distinct()
    return sequences.epoch_sample(rows, "task", {"casual": 200, "word": 100}, 7)
