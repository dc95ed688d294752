"""Queries over votes: majorities, shares, context readings, joins of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lining, normalize, roman, text
from ..operators import pairs, sequences, sets, votes
from .registry import query, table
from .text_queries import B, KEYS_SQL, key_counts

#: Trust in each origin of a training row.
TRUST = {"gold": 3, "wiki": 2, "poem": 2, "casual": 1, "silver": 0}
_TRUST_SQL = "CASE origin " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TRUST.items()) + " ELSE 0 END"
_ROWS_SQL = "SELECT DISTINCT train_id, task, src, tgt, weight, origin FROM train WHERE src <> '' AND tgt <> ''"
_VOTES_SQL = f"SELECT task, src, tgt, sum({_TRUST_SQL})::DECIMAL(18,3) AS w, min(train_id) AS first FROM ({_ROWS_SQL}) WHERE {_TRUST_SQL} > 0 AND task IS NOT NULL GROUP BY ALL"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train").where("src <> '' AND tgt <> ''").select("train_id", "task", "src", "tgt", "weight", "origin").distinct()


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return votes.weighted(_rows(spark, d), ["task", "src"], "tgt", votes.trust(F.col("origin"), TRUST), "train_id")


@query(_VOTES_SQL)
def weighted_votes(spark: SparkSession, d: str) -> DataFrame:
    """Readings of each source text weighed by where they come from."""
    return _votes(spark, d)


@query(f"SELECT task, src, tgt, w, total FROM (SELECT *, row_number() OVER (PARTITION BY task, src ORDER BY w DESC, first, tgt) AS k, (sum(w) OVER (PARTITION BY task, src))::DECIMAL(18,3) AS total FROM ({_VOTES_SQL})) WHERE k = 1")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return votes.majority(_votes(spark, d), ["task", "src"], "tgt")


_ANSWERS_SQL = "SELECT DISTINCT item_id, provider_id, result_id, lower(roman) AS roman FROM translit_results WHERE ok AND roman <> ''"
_EVIDENCE_SQL = f"SELECT item_id, roman, count(*)::DECIMAL(18,3) AS w, min(result_id) AS first FROM ({_ANSWERS_SQL}) GROUP BY item_id, roman"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translit_results").where("ok AND roman <> ''").select("item_id", "provider_id", "result_id", F.lower("roman").alias("roman")).distinct()


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return votes.weighted(_answers(spark, d), ["item_id"], "roman", F.lit(1), "result_id")


@query(f"SELECT item_id, list({{'roman': roman, 'w': w}} ORDER BY k) AS \"values\" FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY w DESC, first, roman) AS k FROM ({_EVIDENCE_SQL})) WHERE k <= 3 GROUP BY item_id")
def top3_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The three commonest romanisations of each item."""
    return votes.top(_evidence(spark, d), ["item_id"], "roman", 3)


@query(f"SELECT item_id, roman, w, total FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY w DESC, first, roman) AS k, (sum(w) OVER (PARTITION BY item_id))::DECIMAL(18,3) AS total FROM ({_EVIDENCE_SQL})) WHERE k = 1 AND w >= 0.6 * total AND total >= 5")
def dominance_override(spark: SparkSession, d: str) -> DataFrame:
    """Romanisations that most annotators of an item give."""
    return votes.dominant(_evidence(spark, d), ["item_id"], "roman")


@query(f"SELECT src, w, coalesce(n, 0) AS n FROM (SELECT {normalize.scheme_key_sql('src')} AS src, sum(weight::DECIMAL(18,3))::DECIMAL(18,3) AS w FROM ({_ROWS_SQL}) WHERE task = 'word' GROUP BY 1) LEFT JOIN (SELECT key, count(*) AS n FROM ({KEYS_SQL}) GROUP BY key) ON src = key WHERE w >= 1 OR coalesce(n, 0) >= 3")
def evidence_kept(spark: SparkSession, d: str) -> DataFrame:
    """Words of the training rows worth keeping: of some weight, or used in the corpus."""
    words = _rows(spark, d).where("task = 'word'").groupBy(normalize.scheme_key(F.col("src")).alias("src")).agg(F.sum(F.col("weight").cast(votes.WEIGHT)).cast(votes.WEIGHT).alias("w"))
    got = words.join(key_counts(spark, d).withColumnRenamed("key", "src"), "src", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return got.where("w >= 1 OR n >= 3").select("src", "w", "n")


# --- words of lines side by side --------------------------------------------------------------------
def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{B}\\n]+'), lambda x: x <> '')"


_ZIP_SQL = (
    f"SELECT train_id, (generate_subscripts(u, 1) - 1)::INTEGER AS pos, unnest(u) AS word, unnest(d) AS reading FROM (SELECT train_id, {sql_words('src')} AS u, {sql_words('tgt')} AS d FROM ({_ROWS_SQL}) WHERE task = 'line') WHERE len(u) = len(d)"
)
_NEAR_SQL = f"SELECT *, lag(word) OVER i AS prev, lead(word) OVER i AS next FROM ({_ZIP_SQL}) WINDOW i AS (PARTITION BY train_id ORDER BY pos)"


def zipped_words(spark: SparkSession, d: str) -> DataFrame:
    """(train_id, pos, word, reading, prev, next) of training lines whose words stand one for one."""
    rows = _rows(spark, d).where("task = 'line'")
    z = sets.zipped(rows, ["train_id"], {"word": text.words(F.col("src")), "reading": text.words(F.col("tgt"))})
    by = Window.partitionBy("train_id").orderBy("pos")
    return z.withColumn("prev", F.lag("word").over(by)).withColumn("next", F.lead("word").over(by))


@query(f"SELECT train_id, pos, word, reading FROM ({_ZIP_SQL})")
def phrase_zip(spark: SparkSession, d: str) -> DataFrame:
    return zipped_words(spark, d).select("train_id", "pos", "word", "reading")


def _majority_sql(keys: str, rows: str) -> str:
    return f"SELECT {keys}, reading, n, total FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, first, reading) AS k, sum(n) OVER (PARTITION BY {keys}) AS total FROM (SELECT {keys}, reading, count(*) AS n, min(train_id) AS first FROM ({rows}) GROUP BY ALL)) WHERE k = 1"


_WORD_SQL = _majority_sql("word", _ZIP_SQL)


def _side_sql(side: str, a: str, b: str, near: str) -> str:
    return f"SELECT '{side}' AS side, m.{a} AS a, m.{b} AS b, m.reading, m.n::BIGINT AS n, m.total::BIGINT AS total FROM ({_majority_sql(f'{a}, {b}', f'SELECT * FROM ({_NEAR_SQL}) WHERE {near} IS NOT NULL')}) m JOIN ({_WORD_SQL}) w ON m.word = w.word WHERE m.reading <> w.reading AND m.n >= 2 AND m.n >= 0.75 * m.total"


@query(f"{_side_sql('L', 'prev', 'word', 'prev')} UNION ALL {_side_sql('R', 'word', 'next', 'next')}")
def context_override(spark: SparkSession, d: str) -> DataFrame:
    """Readings that a word takes next to a certain neighbour and else not."""
    z = zipped_words(spark, d)
    words = votes.majority(votes.weighted(z, ["word"], "reading", F.lit(1), "train_id"), ["word"], "reading")
    out = None
    for side, key, near in (("L", ["prev", "word"], "prev"), ("R", ["word", "next"], "next")):
        v = votes.weighted(z.where(F.col(near).isNotNull()), key, "reading", F.lit(1), "train_id")
        got = votes.context_overrides(v, words, key, "word", "reading")
        got = got.select(F.lit(side).alias("side"), F.col(key[0]).alias("a"), F.col(key[1]).alias("b"), "reading", F.col("w").cast("long").alias("n"), F.col("total").cast("long").alias("total"))
        out = got if out is None else out.unionByName(got)
    return out


def aligned_words(spark: SparkSession, d: str) -> DataFrame:
    """(train_id, pos, word, reading, joiner, next) of training lines lined up with their Devanagari, + for words written
    together."""
    rows = _rows(spark, d).where("task = 'line'").select("train_id", text.urdu_tokens(F.col("src")).alias("t"), "tgt")
    made = rows.select("train_id", "t", lining.output_readings("deva")("t", "tgt").alias("r")).where("r IS NOT NULL AND size(r) = size(t)")
    flat = made.select("train_id", F.posexplode(F.arrays_zip("t", "r")).alias("pos", "z")).select("train_id", "pos", F.col("z.t").alias("word"), F.col("z.r.reading").alias("reading"), F.col("z.r.joiner").alias("joiner"))
    return flat.withColumn("next", F.lead("word").over(Window.partitionBy("train_id").orderBy("pos")))


@query()
def suppress_absorbed(spark: SparkSession, d: str) -> DataFrame:
    """Words with their majority reading, NULL where they are mostly written into the word before (no SQL twin: the lines
    are aligned by dynamic programming)."""
    z = aligned_words(spark, d)
    own = votes.majority(votes.weighted(z.where("joiner <> '+'"), ["word"], "reading", F.lit(1), "train_id"), ["word"], "reading")
    absorbed = z.where("reading IS NULL").groupBy("word").agg(F.count("*").alias("n"))
    return votes.suppressed(own.select("word", "reading", F.col("total").alias("n")), absorbed, "word", "reading")


@query()
def glue_rate(spark: SparkSession, d: str) -> DataFrame:
    """How often the future endings are written together with the verb."""
    z = aligned_words(spark, d).where("next IS NOT NULL").select(F.col("next").alias("ending"), "joiner")
    return votes.glue_rates(z, list(roman.FUTURE), "ending", "joiner")


@query(
    f"WITH p AS (SELECT word, next, reading = '' AS x, nr FROM (SELECT *, lead(reading) OVER (PARTITION BY train_id ORDER BY pos) AS nr FROM ({_NEAR_SQL})) WHERE next IS NOT NULL), t AS (SELECT word, next, count(*) FILTER (contains(nr, '-') OR contains(nr, '''')) AS joined, count(*) FILTER (NOT (contains(nr, '-') OR contains(nr, ''''))) AS apart FROM p GROUP BY ALL) SELECT * FROM t WHERE word IN (SELECT word FROM t WHERE joined > 0)"
)
def pair_tallies(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours by whether the second's reading carries a join or ain mark; only first words that ever meet one."""
    z = zipped_words(spark, d).withColumn("nr", F.lead("reading").over(Window.partitionBy("train_id").orderBy("pos"))).where("next IS NOT NULL")
    return votes.pair_tallies(z.withColumn("j", F.col("nr").contains("-") | F.col("nr").contains("'")), "word", "next", "j")


@query(
    f"WITH z AS ({_ZIP_SQL}), total AS (SELECT word, count(*) AS total FROM z GROUP BY word), hit AS (SELECT word, reading, count(*) AS hit FROM z GROUP BY ALL), "
    f"r AS (SELECT test_id, unnest(u) AS word, unnest(d) AS reading FROM (SELECT test_id, {sql_words('urdu')} AS u, {sql_words('deva')} AS d FROM test) WHERE len(u) = len(d)) "
    "SELECT test_id, round(coalesce(sum(CASE WHEN total IS NOT NULL THEN ln((coalesce(hit, 0) + 0.5) / (total + 1.0)) END), 0), 6) AS score FROM r LEFT JOIN total USING (word) LEFT JOIN hit USING (word, reading) GROUP BY test_id"
)
def agreement_logshare(spark: SparkSession, d: str) -> DataFrame:
    """How far the evaluation readings agree with those of the training lines."""
    counts = zipped_words(spark, d).groupBy("word", "reading").agg(F.count("*").alias("n"))
    rows = sets.zipped(table(spark, d, "test"), ["test_id"], {"word": text.words(F.col("urdu")), "reading": text.words(F.col("deva"))})
    return votes.log_shares(rows, counts, "word", "reading", ["test_id"])


@query("SELECT roman, devanagari, w, total FROM (SELECT *, row_number() OVER (PARTITION BY roman ORDER BY w DESC, devanagari) AS k, (sum(w) OVER (PARTITION BY roman))::DECIMAL(18,3) AS total FROM (SELECT rekhta AS roman, deva AS devanagari, sum(CASE WHEN tier = 'A' THEN 5 ELSE 1 END)::DECIMAL(18,3) AS w FROM dictionary WHERE rekhta IS NOT NULL AND deva IS NOT NULL GROUP BY ALL)) WHERE k = 1")
def roman_to_devanagari(spark: SparkSession, d: str) -> DataFrame:
    """The usual Devanagari of each marked reading, headwords weighing five, other entries one."""
    rows = table(spark, d, "dictionary").withColumn("one", F.lit(0))
    v = votes.weighted(rows, ["rekhta"], "deva", F.when(F.col("tier") == "A", 5).otherwise(1), "one")
    return votes.majority(v, ["rekhta"], "deva").select(F.col("rekhta").alias("roman"), F.col("deva").alias("devanagari"), "w", "total")


@query("SELECT src, arg_max(tgt, (w, -first)) AS tgt FROM (SELECT src, tgt, count(*) AS w, min(train_id) AS first FROM (SELECT DISTINCT train_id, src, tgt FROM train WHERE task = 'casual' AND src <> '' AND tgt <> '') GROUP BY ALL) GROUP BY src")
def best_romanisation(spark: SparkSession, d: str) -> DataFrame:
    """The commonest romanisation of each text, the first of equal ones."""
    v = votes.weighted(_rows(spark, d).where("task = 'casual'"), ["src"], "tgt", F.lit(1), "train_id")
    return votes.majority(v, ["src"], "tgt").select("src", "tgt")


@query("SELECT src, tgt, CASE WHEN origin = 'wiki' THEN CASE WHEN weight >= 0.5 THEN 'W1' ELSE 'W2' END WHEN weight >= 0.7 AND length(src) >= 1 THEN 'A' WHEN weight >= 0.5 THEN 'B' END AS tier FROM (SELECT DISTINCT train_id, src, tgt, origin, weight FROM train WHERE task = 'word' AND src <> '')")
def rank_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Word rows in tiers by confidence and source."""
    rows = table(spark, d, "train").where("task = 'word' AND src <> ''").select("train_id", "src", "tgt", "origin", "weight").distinct()
    tier = sequences.silver_tiers(F.col("weight"), F.lit(1), F.length("src"), F.coalesce(F.col("origin") == "wiki", F.lit(False)))
    return rows.select("src", "tgt", tier.alias("tier"))


@query()
def evidence_reading(spark: SparkSession, d: str) -> DataFrame:
    """Of several readings of an item the one most like how people write it."""
    v = _evidence(spark, d).select("item_id", F.col("roman").alias("plain"), F.col("w").alias("n"))
    e = _answers(spark, d).groupBy("item_id", "roman").agg(F.count("*").alias("w"))
    return pairs.by_evidence(v, e, "item_id", "plain")


@query()
def name_capitals(spark: SparkSession, d: str) -> DataFrame:
    """Words that are written with a capital more often than not inside a line."""
    rows = table(spark, d, "documents").where("lang = 'en'").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("n", "line"))
    words = rows.select("doc_id", F.posexplode(text.edge_tokens(F.col("line"))).alias("pos", "w")).select(F.lower("w").alias("key"), "w", (F.col("pos") > 0).alias("inside"))
    return votes.capitals(words, "key", "w", "inside").where("capital").select("key")
