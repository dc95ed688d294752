"""Queries over splits, sets and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize, text
from ..operators import pairs, sequences, sets
from .registry import query, table
from .text_queries import LINES_SQL, sql_positions
from .vote_queries import sql_words


def _bucket_sql(x: str) -> str:
    return f"(CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT) / 4294967295.0)"


def _split_sql(x: str, test: float, dev: float) -> str:
    return f"CASE WHEN {_bucket_sql(x)} < {test} THEN 'test' WHEN {_bucket_sql(x)} < {round(test + dev, 9)} THEN 'dev' ELSE 'train' END"


@query(f"SELECT src, {_split_sql('src', 0.04, 0.02)} AS split FROM (SELECT DISTINCT src FROM train WHERE src <> '')")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """A split of every source text by its own hash: .04 test, .02 dev."""
    rows = table(spark, d, "train").where("src <> ''").select("src").distinct()
    return rows.select("src", sets.split_by_hash(F.col("src"), {"test": 0.04, "dev": 0.02}).alias("split"))


@query(f"SELECT DISTINCT label_id, CASE WHEN s = 'dak' THEN CASE WHEN grp = 'test' THEN 'test' ELSE 'dev' END WHEN s = 'word' THEN 'train' ELSE {_split_sql(chr(115) + ' || ' + repr(':') + ' || coalesce(grp, ' + repr('') + ')', 0.03, 0.01)} END AS split FROM (SELECT label_id, lower(trim(src)) AS s, grp FROM teacher_labels)")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    """Labels split by source and group: .03 test, .01 dev; two sources have splits of their own."""
    s = F.lower(F.trim("src"))
    by_hash = sets.split_by_hash(F.concat(s, F.lit(":"), F.coalesce("grp", F.lit(""))), {"test": 0.03, "dev": 0.01})
    split = F.when(s == "dak", F.when(F.col("grp") == "test", "test").otherwise("dev")).when(s == "word", "train").otherwise(by_hash)
    return table(spark, d, "teacher_labels").select("label_id", split.alias("split")).distinct()


@query(f"SELECT title, CASE WHEN {_bucket_sql(repr('poem:') + ' || title')} < 0.08 THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT grp AS title FROM teacher_labels WHERE lower(trim(src)) = 'poem' AND grp <> '')")
def poem_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "teacher_labels").where("lower(trim(src)) = 'poem' AND grp <> ''").select(F.col("grp").alias("title")).distinct()
    return rows.select("title", sets.split_by_hash(F.concat(F.lit("poem:"), F.col("title")), {"test": 0.08}).alias("split"))


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(slug), 1, 8) AS BIGINT) % 10 < 3 THEN 'test' WHEN slug IS NOT NULL THEN 'dev' END AS split FROM documents")
def slug_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents by their work: three tenths test, the rest dev; without a work none."""
    return table(spark, d, "documents").select("doc_id", sets.split_by_place(F.col("slug")).alias("split"))


_SCHEME_SRC = normalize.scheme_key_sql("src")


@query(f"SELECT DISTINCT train_id, src, tgt FROM train WHERE src IS NOT NULL AND {_SCHEME_SRC} NOT IN (SELECT {normalize.scheme_key_sql('urdu')} FROM test WHERE urdu IS NOT NULL)")
def heldout_removal(spark: SparkSession, d: str) -> DataFrame:
    """Training rows without any text that is held out anywhere."""
    held = table(spark, d, "test").select(normalize.scheme_key(F.col("urdu")).alias("key"))
    rows = table(spark, d, "train").where("src IS NOT NULL").select("train_id", "src", "tgt").distinct()
    return sets.without(rows.withColumn("key", normalize.scheme_key(F.col("src"))), held, "key").drop("key")


@query("SELECT DISTINCT urdu, 'dev' AS split FROM test WHERE split = 'dev' AND urdu IS NOT NULL AND urdu NOT IN (SELECT urdu FROM test WHERE split = 'test' AND urdu IS NOT NULL) UNION ALL SELECT DISTINCT urdu, 'test' FROM test WHERE split = 'test' AND urdu IS NOT NULL")
def held_sets(spark: SparkSession, d: str) -> DataFrame:
    """What is held out: dev less test, and test."""
    t = table(spark, d, "test").where("urdu IS NOT NULL")
    dev, test = (t.where(F.col("split") == s).select("urdu") for s in ("dev", "test"))
    return dev.subtract(test).withColumn("split", F.lit("dev")).unionByName(test.distinct().withColumn("split", F.lit("test")))


@query("SELECT DISTINCT urdu FROM translit_items WHERE urdu IS NOT NULL AND urdu NOT IN (SELECT src FROM train WHERE src IS NOT NULL UNION SELECT urdu FROM test WHERE urdu IS NOT NULL UNION SELECT urdu FROM dictionary WHERE urdu IS NOT NULL)")
def unseen_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that no vote, held set or dictionary knows."""
    seen = table(spark, d, "train").select(F.col("src").alias("urdu")).unionByName(table(spark, d, "test").select("urdu")).unionByName(table(spark, d, "dictionary").select("urdu"))
    return sets.without(table(spark, d, "translit_items").where("urdu IS NOT NULL").select("urdu").distinct(), seen, "urdu")


@query("SELECT DISTINCT src AS urdu FROM train WHERE src IS NOT NULL INTERSECT SELECT urdu FROM dictionary WHERE deva IS NOT NULL")
def gold_with_devanagari(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "train").where("src IS NOT NULL").select(F.col("src").alias("urdu"))
    return rows.intersect(table(spark, d, "dictionary").where("deva IS NOT NULL").select("urdu"))


@query("SELECT DISTINCT item_id, urdu FROM translit_items WHERE substr(md5(urdu), 1, 16) NOT IN (SELECT id FROM teacher_labels WHERE id IS NOT NULL) AND urdu IS NOT NULL")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Items whose content has no label yet."""
    items = table(spark, d, "translit_items").where("urdu IS NOT NULL").select("item_id", "urdu").distinct()
    return sets.without(items.withColumn("id", sets.content_id(F.col("urdu"))), table(spark, d, "teacher_labels"), "id").drop("id")


# --- sequences --------------------------------------------------------------------------------------
_RAW = "list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: regexp_replace(x, '^ +| +$', '', 'g'))"


@query(f"SELECT doc_id, line_no, line, (sum((line = '')::INT) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS part FROM ({sql_positions('doc_id', _RAW, 'documents', 'line_no', 'line')}) QUALIFY line <> ''")
def sentence_groups(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the documents by stanza or paragraph: blank lines part them."""
    lines = F.transform(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x))
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(lines).alias("line_no", "line"))
    return sequences.between(rows, ["doc_id"], ["line_no"], F.col("line") == "")


@query(f"SELECT doc_id, line_no, (line_no // 8)::INTEGER AS chunk FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({sql_positions('doc_id', LINES_SQL, 'documents', 'line_no', 'line')})) WHERE (line_no // 8 + 1) * 8 <= n")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Full chunks of eight lines of each document."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line"))
    return sequences.fixed_chunks(rows, ["doc_id"], ["line_no"]).select("doc_id", "line_no", "chunk")


@query(f"SELECT doc_id, (line_no // 2)::INTEGER AS couplet, string_agg(line, ' / ' ORDER BY line_no) AS lines FROM ({sql_positions('doc_id', LINES_SQL, 'documents', 'line_no', 'line')}) GROUP BY ALL")
def couplets(spark: SparkSession, d: str) -> DataFrame:
    """Lines in pairs."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line"))
    packed = rows.groupBy("doc_id", sequences.couplets(F.col("line_no")).alias("couplet")).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return packed.select("doc_id", "couplet", F.array_join(F.transform("x", lambda e: e["line"]), " / ").alias("lines"))


@query()
def poem_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Verse in chunks for labelling, cut at stanza breaks (no SQL twin: the cut depends on what is gathered so far)."""
    lines = F.transform(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x))
    rows = table(spark, d, "documents").where("lower(trim(source)) = 'poem'").select("doc_id", F.posexplode(lines).alias("line_no", "line"))
    return sequences.poem_chunks(rows, "doc_id", "line_no", "line")


@query(
    f"SELECT unnest(u) AS urdu, unnest(r) AS roman FROM (SELECT u, CASE WHEN len(u) = len(r) THEN r WHEN len(u) = 1 THEN [replace(tgt, '-', '')] END AS r FROM (SELECT {sql_words('src')} AS u, list_filter(string_split_regex(tgt, '[ -]'), lambda x: x <> '') AS r, tgt FROM (SELECT DISTINCT train_id, src, tgt FROM train WHERE task = 'casual' AND src <> '' AND tgt <> ''))) WHERE r IS NOT NULL"
)
def phrase_words(spark: SparkSession, d: str) -> DataFrame:
    """Word pairs of romanised phrases whose words line up."""
    rows = table(spark, d, "train").where("task = 'casual' AND src <> '' AND tgt <> ''").select("train_id", "src", "tgt").distinct()
    return pairs.phrase_pairs(rows.select(F.array_join(text.words(F.col("src")), " ").alias("src"), "tgt"), "src", "tgt")


@query("SELECT task, src, tgt, round(least(w, 4), 2)::DECIMAL(6,2)::VARCHAR AS w FROM (SELECT task, src, tgt, sum(weight::DECIMAL(18,3)) AS w FROM (SELECT DISTINCT train_id, task, src, tgt, weight FROM train) GROUP BY ALL)")
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as they are written for training: weights summed, capped, two digits."""
    from ..sources.writers import training_rows as made

    return made(table(spark, d, "train").select("train_id", "task", "src", "tgt", "weight").distinct())
