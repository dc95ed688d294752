"""Queries over readings: R and its renders, candidates, alignment, meter, choosing among readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import candidates, fold, letters, lining, meter, roman, runs, text
from ..operators import ensemble, pairs, sets
from .registry import query, table
from .text_queries import key_counts
from .vote_queries import sql_words

GOLDEN = "a golden: the SQL only lists what is right"

#: R readings and their four renders.
RENDERS = [
    ("kyā", "kya", "kyā", "kyā", "kyaa"), ("hai~", "hain", "haiñ", "haiñ", "haiñ"), ("kahnā", "kehna", "kahnā", "kahnā", "kahnaa"), ("xayāl", "khayaal", "ḳhayāl", "ḳhayāl", "KHayaal"),
    ("jāe~", "jaayein", "jāeñ", "jaa.eñ", "jaa.eñ"), ("paṛhāī", "padhaai", "paṛhāī", "paḍhā.ī", "pa.Dhaa.ii"), ("ma'lūm", "maloom", "ma'lūm", "ma'lūm", "ma'luum"), ("dil-e-nādā~", "dil-e-naadan", "dil-e-nādāñ", "dil-e-nādāñ", "dil-e-naadaañ"),
]


def _values(rows: list[tuple], names: str) -> str:
    def one(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


@query(_values(RENDERS, "rich, plain, marked, printed, ascii"))
def r_render_cases(spark: SparkSession, d: str) -> DataFrame:
    r = spark.createDataFrame([(x[0],) for x in RENDERS], "rich string")
    return r.select("rich", roman.plain("rich").alias("plain"), roman.marked("rich").alias("marked"), roman.printed("rich").alias("printed"), roman.ascii_table("rich").alias("ascii"))


DICTIONARY = [("kyā", "کیا", "kyā"), ("nahī̃", "نہیں", "nahī~"), ("ḵẖayāl", "خیال", "xayāl"), ("khayaal", "خیال", "xayaal"), ("cirāġ", "چراغ", "cirāġ"), ("ʻilm", "علم", "'ilm"), ("karẽ, kījie", "", None), ("a-", "", None)]


@query(_values(DICTIONARY, "roman, urdu, rich"))
def dictionary_to_r_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([x[:2] for x in DICTIONARY], "roman string, urdu string")
    return rows.select("roman", "urdu", roman.rich_of_dictionary("roman", "urdu").alias("rich"))


LETTERS = [("چمکتے", "चमकते", "chamakte"), ("نکلتے", "नकलते", "nakalte"), ("مکّہ", "मक्कह", "makkah"), ("ذریعہ", "ज़रीह", "zarih"), ("آگ", "आग", "aag")]


@query(_values(LETTERS, "urdu, devanagari, roman"))
def letter_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([x[:1] for x in LETTERS], "urdu string")
    return rows.select("urdu", letters.read_letters("urdu").alias("r")).select("urdu", "r.devanagari", "r.roman")


READINGS = [("किताब", "kitāb"), ("करती", "kartī"), ("हिचकता", "hicaktā"), ("संयोग", "sa~yog"), ("वंश", "vañś"), ("कई", "kaī"), ("दुःख", "duhkh"), ("abc", None)]


@query(_values(READINGS, "deva, rich"))
def schwa_cases(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([x[:1] for x in READINGS], "deva string").select("deva", F.get(candidates.readings("deva"), 0).alias("rich"))


NUKTAS = [("قانون", "कानून", "क़ानून"), ("کام", "काम", "काम"), ("کتاب", "मकान", None)]


@query(_values(NUKTAS, "urdu, deva, restored"))
def nukta_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([x[:2] for x in NUKTAS], "urdu string, deva string")
    return rows.select("urdu", "deva", candidates.nuktas_restored("urdu", "deva").alias("restored"))


FAULTS = [("دل ہی تو ہے", "दिल ही तो है", "دل ہی تو ہے", ""), ("جو کو", "जो को को को को", "جو کو کو کو کو", "words"), ("مکر", "मुकर्रर", "مقرر", "roundtrip"), ("مکر", "makar", "مکر", "latin"), ("مکر", "", "", "length")]


@query(_values(FAULTS, "ur, hi, back, fault"))
def fault_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([x[:3] for x in FAULTS], "ur string, hi string, back string")
    return rows.select("ur", "hi", "back", lining.fault("ur", "hi", "back").alias("fault"))


# --- whole tables -----------------------------------------------------------------------------------
def _readings(spark: SparkSession, d: str) -> DataFrame:
    """(test_id, deva, rich): the evaluation rows' Devanagari in R, word by word, by the default schwa rule."""
    words = table(spark, d, "test").where("deva <> ''").select("test_id", F.posexplode(text.words(F.col("deva"))).alias("pos", "w"))
    forms = words.select("w").distinct().select("w", F.coalesce(F.get(candidates.readings(F.regexp_replace("w", "[^\\x{900}-\\x{97F}]", "")), 0), F.col("w")).alias("r"))
    packed = words.join(forms, "w").groupBy("test_id").agg(F.sort_array(F.collect_list(F.struct("pos", "r"))).alias("x"))
    return packed.select("test_id", F.array_join(F.transform("x", lambda e: e["r"]), " ").alias("rich"))


@query()
def r_renders(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows in R and its four renders."""
    r = _readings(spark, d)
    return r.select("test_id", "rich", roman.plain("rich").alias("plain"), roman.marked("rich").alias("marked"), roman.printed("rich").alias("printed"), roman.ascii_table("rich").alias("ascii"), roman.simple(roman.printed("rich")).alias("simple"))


@query()
def deva_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Urdu spellings and R readings of every distinct Devanagari word of the dictionary."""
    words = table(spark, d, "dictionary").where("deva IS NOT NULL").select("deva").distinct()
    return words.select("deva", F.size(candidates.spellings("deva")).alias("spellings"), F.get(candidates.spellings("deva"), 0).alias("urdu"), candidates.readings("deva").alias("readings"))


@query()
def align_spans(spark: SparkSession, d: str) -> DataFrame:
    """Teacher labels' Urdu and Devanagari lined up; NULL where they don't."""
    rows = table(spark, d, "teacher_labels").where("ur <> '' AND hi <> ''").select("label_id", "ur", "hi").distinct()
    return rows.select("label_id", lining.spans("ur", "hi").alias("spans"))


@query()
def reason_code(spark: SparkSession, d: str) -> DataFrame:
    """Teacher labels by source and the fault found in them: the cheap tests in the JVM, the alignment for what is left."""
    rows = table(spark, d, "teacher_labels").select("label_id", "src", "ur", "hi", "back").distinct()
    ur, hi = F.coalesce("ur", F.lit("")), F.coalesce("hi", F.lit(""))
    cheap = F.when((hi == "") | (F.length(hi) > 2 * F.length(ur) + 12), "length").when(hi.rlike("[A-Za-z]"), "latin")
    first = rows.withColumn("fault", cheap)
    left = first.where("fault IS NULL").withColumn("fault", lining.fault("ur", "hi", "back"))
    return first.where("fault IS NOT NULL").unionByName(left).groupBy(F.lower(F.trim("src")).alias("src"), "fault").agg(F.count("*").alias("n"))


@query()
def run_segments(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the evaluation rows as the line models see them."""
    rows = table(spark, d, "test").where("urdu IS NOT NULL")
    return rows.select("test_id", runs.line_segments("urdu").alias("segments"), runs.pen_name_flags("urdu").alias("pen_names"))


@query()
def syllables(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows scanned."""
    return _readings(spark, d).select("test_id", meter.line_weights("rich").alias("weights"))


#: Eight lines of one poem, in R, and the four forms of its meter.
POEM = ["dil-e-nādā~ tujhe huā kyā hai", "āxir is dard kī davā kyā hai", "ham hai~ muśtāq aur vo be-zār", "yā ilāhī ye mājrā kyā hai", "mai~ bhī mu~h me~ zabān rakhtā hū~", "kāś pūcho ki muddaā kyā hai", "phir ye haṅgāma ai xudā kyā hai", "abr kyā cīz hai havā kyā hai"]
METERS = ["-u--u-u-uu-", "uu--u-u-uu-", "-u--u-u---", "uu--u-u---"]


@query("SELECT i AS line, true AS scans FROM range(0, 8) t(i)")
def meter_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a poem that fit one of its meters (a golden: all do)."""
    lines = spark.createDataFrame(list(enumerate(POEM)), "line bigint, rich string").withColumn("w", meter.line_weights("rich"))
    fits = None
    for m in METERS:
        one = meter.scans(F.col("w"), F.lit(m))
        fits = one if fits is None else fits | one
    return lines.select("line", fits.alias("scans"))


@query()
def meter_support(spark: SparkSession, d: str) -> DataFrame:
    """For each line of the evaluation rows' poems, taken together by source, with how many others it shares a meter."""
    lines = _readings(spark, d).join(table(spark, d, "test").select("test_id", "source", "split"), "test_id").where("source = 'poem'")
    return ensemble.meter_support(lines, ["source", "split"], "test_id", "rich")


def _hyps(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, pos, rich, plain, devanagari, score): answers as a beam, the quicker the better."""
    rows = table(spark, d, "translit_results").where("ok AND roman <> '' AND devanagari <> ''").select("item_id", "result_id", "roman", "devanagari", "ms").distinct()
    return rows.select("item_id", F.col("result_id").alias("pos"), F.lower("roman").alias("rich"), F.lower("roman").alias("plain"), "devanagari", (-F.col("ms") / 1000.0).alias("score"))


@query()
def beam_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Each item's answers reranked by how people romanise it and by the known Devanagari words."""
    h = _hyps(spark, d)
    votes = h.groupBy("item_id", F.col("plain").alias("roman")).agg(F.count("*").cast("double").alias("n"))
    evidence = ensemble.scaled(votes, "item_id", "roman", "n")
    items = table(spark, d, "translit_items").select("item_id", "urdu").distinct()
    known = items.join(table(spark, d, "dictionary").select("urdu", fold.fold_hindi(F.col("deva")).alias("word")), "urdu").select("item_id", "word")
    return ensemble.reranked(h, "item_id", evidence, known)


@query()
def spelling_override(spark: SparkSession, d: str) -> DataFrame:
    """Fastest answers that a clear majority contradicts."""
    h = _hyps(spark, d)
    first = h.groupBy("item_id").agg(F.max_by("plain", F.struct("score", (-F.col("pos")).alias("p"))).alias("plain"))
    votes = h.groupBy("item_id", F.col("plain").alias("roman")).agg(F.count("*").cast("double").alias("w"))
    return ensemble.overruled(first, votes, "item_id")


_T = "SELECT item_id, devanagari AS text, ms < 200 AS sound, -ms / 1000.0 AS lp FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, result_id DESC) AS k FROM (SELECT DISTINCT result_id, item_id, provider_id, ok, devanagari, ms, created_at FROM translit_results WHERE ok AND devanagari <> '' AND provider_id = 'ravi')) WHERE k = 1"
_C = "SELECT item_id, text, lp, 0.0 AS score FROM (SELECT DISTINCT item_id, devanagari AS text, -ms / 1000.0 AS lp FROM translit_results WHERE ok AND devanagari <> '' AND provider_id <> 'ravi')"


@query(
    f"SELECT t.item_id, CASE WHEN keep THEN t.text ELSE b END AS text, CASE WHEN keep THEN 'teacher' ELSE 'candidate' END AS source FROM (SELECT t.*, c.b, t.sound OR c.b IS NULL OR t.lp >= c.l - 0.3 AS keep FROM ({_T}) t LEFT JOIN (SELECT item_id, arg_min(text, (-lp, -lp, text)) AS b, max(lp) AS l FROM ({_C}) GROUP BY item_id) c USING (item_id)) t"
)
def ensemble_choose(spark: SparkSession, d: str) -> DataFrame:
    """One provider as the teacher, the others as candidates where it took long."""
    rows = table(spark, d, "translit_results").where("ok AND devanagari <> ''").select("result_id", "item_id", "provider_id", F.col("devanagari").alias("text"), "ms", "created_at").distinct()
    lp = -F.col("ms") / 1000.0
    own = rows.where("provider_id = 'ravi'").groupBy("item_id").agg(F.max_by(F.struct("text", "ms"), F.struct("created_at", "result_id")).alias("b")).select("item_id", "b.*")
    teacher = own.select("item_id", "text", (F.col("ms") < 200).alias("sound"), lp.alias("lp"))
    others = rows.where("provider_id <> 'ravi'").select("item_id", "text", lp.alias("lp"), F.lit(0.0).alias("score")).distinct()
    return ensemble.chosen(teacher, others, "item_id")


# --- pairs ------------------------------------------------------------------------------------------
@query()
def attested_argmax(spark: SparkSession, d: str) -> DataFrame:
    """Urdu spellings of the evaluation rows' Devanagari words that the documents use."""
    words = table(spark, d, "test").select(F.explode(text.words(F.col("deva"))).alias("deva"))
    counts = key_counts(spark, d).withColumnRenamed("key", "urdu")
    known = table(spark, d, "dictionary").where("tier = 'A'").select("urdu")
    return pairs.attested(words, counts, known)


@query()
def silver_join(spark: SparkSession, d: str) -> DataFrame:
    """Urdu words read through Devanagari words that people romanise alike."""
    urdu = table(spark, d, "dictionary").where("urdu <> '' AND plain <> ''").select("urdu", F.col("plain").alias("roman"), F.lit(1.0).alias("w"))
    hindi = sets.zipped(table(spark, d, "test"), ["test_id"], {"roman": text.words(F.col("rich")), "deva": text.words(F.col("deva"))})
    return pairs.silver(urdu, hindi.select("deva", "roman", F.lit(1.0).alias("w")))


@query(
    f"SELECT DISTINCT u.urdu, h.deva FROM (SELECT urdu, {fold.fold_roman_sql('plain')} AS f FROM dictionary WHERE urdu <> '' AND plain <> '') u JOIN (SELECT deva, {fold.fold_roman_sql('roman')} AS f FROM (SELECT unnest(r) AS roman, unnest(d) AS deva FROM (SELECT {sql_words('rich')} AS r, {sql_words('deva')} AS d FROM test) WHERE len(r) = len(d))) h USING (f)"
)
def fold_join(spark: SparkSession, d: str) -> DataFrame:
    """Urdu and Devanagari words whose romanisations fold together."""
    urdu = table(spark, d, "dictionary").where("urdu <> '' AND plain <> ''").select("urdu", fold.fold_roman(F.col("plain")).alias("f"))
    z = sets.zipped(table(spark, d, "test"), ["test_id"], {"roman": text.words(F.col("rich")), "deva": text.words(F.col("deva"))})
    return urdu.join(z.select("deva", fold.fold_roman(F.col("roman")).alias("f")).distinct(), "f").select("urdu", "deva").distinct()


_KNOWN = "SELECT urdu AS known, sum(freq) AS weight FROM dictionary WHERE tier = 'A' AND urdu <> '' GROUP BY urdu"
_OCR_WORDS = f"SELECT DISTINCT unnest({sql_words('text')}) AS word FROM ocr_results WHERE text IS NOT NULL"


def _sql_shortened(x: str) -> str:
    return f"list_distinct(list_concat([{x}], list_transform(range(1, length({x}) + 1), lambda i: substr({x}, 1, i::INT - 1) || substr({x}, i::INT + 1))))"


def _sql_marked(x: str) -> str:
    return f"list_transform(range(1, length({x}) + 1), lambda i: substr({x}, 1, i::INT - 1) || '*' || substr({x}, i::INT + 1))"


@query(
    f"WITH k AS ({_KNOWN}), w AS (SELECT word FROM ({_OCR_WORDS}) WHERE length(word) >= 3 AND word NOT IN (SELECT known FROM k)), "
    f"near AS (SELECT word, known FROM (SELECT word, unnest({_sql_marked('word')}) AS m FROM w) JOIN (SELECT known, unnest({_sql_marked('known')}) AS m FROM k) USING (m) UNION SELECT word, known FROM (SELECT word, unnest({_sql_shortened('word')}) AS m FROM w) a JOIN k ON a.m = k.known AND length(k.known) = length(word) - 1 "
    f"UNION SELECT word, known FROM w JOIN (SELECT known, unnest({_sql_shortened('known')}) AS m FROM k) b ON w.word = b.m AND length(b.known) = length(w.word) + 1), "
    "r AS (SELECT word, known, weight, row_number() OVER (PARTITION BY word ORDER BY weight DESC) AS i, count(*) OVER (PARTITION BY word, weight) AS ties FROM near JOIN k USING (known)) SELECT word, known FROM r WHERE i = 1 AND ties = 1 AND weight >= 50"
)
def spellfix_d1(spark: SparkSession, d: str) -> DataFrame:
    """Words of OCR pages with one frequent word an edit away."""
    words = table(spark, d, "ocr_results").where("text IS NOT NULL").select(F.explode(text.words(F.col("text"))).alias("word")).distinct()
    known = table(spark, d, "dictionary").where("tier = 'A' AND urdu <> ''").groupBy(F.col("urdu").alias("known")).agg(F.sum("freq").alias("weight"))
    return pairs.spell_fixes(words, known)


@query()
def known_forms(spark: SparkSession, d: str) -> DataFrame:
    """Devanagari words of the training rows that spell a word of the dictionary."""
    words = table(spark, d, "dictionary").where("urdu IS NOT NULL").select("urdu")
    vocabulary = table(spark, d, "train").where("task = 'word' AND tgt <> ''").select(F.col("tgt").alias("deva"))
    return pairs.known_forms(words, vocabulary)


@query()
def gold_targets(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary's words with the teacher's spelling where only conventions differ."""
    gold = table(spark, d, "dictionary").where("urdu IS NOT NULL AND deva IS NOT NULL").select("urdu", "deva")
    teacher = table(spark, d, "teacher_labels").where("lower(trim(src)) = 'word' AND ur IS NOT NULL").groupBy(F.col("ur").alias("urdu")).agg(F.min("hi").alias("deva"))
    return pairs.gold_targets(gold, teacher)
