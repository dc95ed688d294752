"""Queries over texts: lines, tokens, normal forms, folds, tests and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars as C
from ..functions import fold, normalize, text
from ..operators import lookup, sequences, sets
from ..sources import readers
from .registry import query, table

B = C.BLANK
RUN, GAP = C.URDU_RUN, C.GAP_RUN
P = text.PUNCT


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{B}]+|[{B}]+$', '', 'g')"


def sql_positions(cols: str, expr: str, source: str, pos: str = "pos", item: str = "tok") -> str:
    """A query of list items with their places from 0."""
    return f"SELECT {cols}, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS {pos}, unnest(l) AS {item} FROM (SELECT {cols}, {expr} AS l FROM {source})"


LINES_SQL = f"list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: {sql_trim('x')}), lambda x: x <> '')"


@query(sql_positions("doc_id", LINES_SQL, "documents", "line_no", "line"))
def line_explode(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every document."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line"))


TOKENS_SQL = sql_positions("doc_id, lang", f"regexp_extract_all(text, '{RUN}|{GAP}')", "documents")


@query(f"SELECT doc_id, pos, tok, regexp_full_match(tok, '{RUN}') AS is_word FROM ({TOKENS_SQL})")
def token_stream(spark: SparkSession, d: str) -> DataFrame:
    """Urdu runs and what lies between them; joined again they are the text."""
    return lookup.tokens(table(spark, d, "documents"), "doc_id", "text")


SENTENCES_SQL = f"list_filter(list_transform(string_split_regex(text, '[\\n۔؟!.]+'), lambda x: trim(regexp_replace(x, '[{B}]+', ' ', 'g'))), lambda x: x <> '')"


def sql_urdu_letters(x: str) -> str:
    return f"len(regexp_extract_all(regexp_replace({x}, '[^\\x{{600}}-\\x{{6FF}}]', '', 'g'), '\\p{{L}}'))"


def sql_letters(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\p{{L}}'))"


@query(
    f"SELECT sentence, first['doc_id'] AS doc_id, first['pos'] AS pos FROM (SELECT sentence, min(row(doc_id, pos)::STRUCT(doc_id BIGINT, pos INTEGER)) AS first FROM ({sql_positions('doc_id', SENTENCES_SQL, 'documents', 'pos', 'sentence')}) "
    f"WHERE {sql_letters('sentence')} > 0 AND {sql_urdu_letters('sentence')} >= 0.6 * {sql_letters('sentence')} AND len(list_filter(string_split_regex(sentence, '[{B}]+'), lambda x: x <> '')) BETWEEN 3 AND 18 GROUP BY sentence)"
)
def clean_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Urdu sentences of 3 to 18 words where they first stand."""
    s = table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))
    kept = s.where((text.urdu_share(F.col("sentence")) >= 0.6) & text.word_count_between(F.col("sentence"), 3, 18))
    return sequences.first_occurrence(kept, "sentence", ["doc_id", "pos"])


@query(
    f"SELECT doc_id, {sql_letters('text')}::BIGINT AS letters, {sql_urdu_letters('text')}::BIGINT AS urdu, {sql_letters('text')} > 0 AND {sql_urdu_letters('text')} >= 0.6 * {sql_letters('text')} AS is_urdu, "
    f"{sql_letters('text')} > 0 AND {sql_urdu_letters('text')} >= 0.9 * {sql_letters('text')} AS is_verse FROM documents WHERE text IS NOT NULL"
)
def letter_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Letters, Urdu ones among them, and whether they are enough for prose and for verse."""
    t = F.col("text")
    share = F.coalesce(text.urdu_share(t), F.lit(0.0))
    letters = F.regexp_count(t, F.lit(r"\p{L}")).cast("long")
    urdu = F.regexp_count(t, F.lit(r"[\x{600}-\x{6FF}&&\p{L}]")).cast("long")
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", letters.alias("letters"), urdu.alias("urdu"), (share >= 0.6).alias("is_urdu"), (share >= 0.9).alias("is_verse"))


CORE_SQL = f"SELECT doc_id, lang, regexp_replace(tok, '^[{P}]+|[{P}]+$', '', 'g') AS core FROM ({TOKENS_SQL}) WHERE regexp_full_match(tok, '{RUN}')"
KEYS_SQL = f"SELECT doc_id, lang, {normalize.scheme_key_sql('core')} AS key FROM ({CORE_SQL}) WHERE core <> ''"


def document_keys(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lang, key) of every Urdu word of the documents; the scheme key is made once for each distinct word."""
    words = table(spark, d, "documents").select("doc_id", "lang", F.explode(text.urdu_tokens(F.col("text"))).alias("core"))
    return words.select("doc_id", "lang", normalize.scheme_key(F.col("core")).alias("key"))


def key_counts(spark: SparkSession, d: str, *by: str) -> DataFrame:
    """(by..., key, n): counted by stored form first, so that only distinct forms are normalised."""
    words = table(spark, d, "documents").select(*by, F.explode(text.urdu_tokens(F.col("text"))).alias("core"))
    forms = words.groupBy(*by, "core").agg(F.count("*").alias("n"))
    return forms.withColumn("key", normalize.scheme_key(F.col("core"))).where("key <> ''").groupBy(*by, "key").agg(F.sum("n").alias("n"))


@query(f"SELECT key, count(*) AS n FROM ({KEYS_SQL}) WHERE key <> '' GROUP BY key ORDER BY n DESC, key LIMIT 500")
def token_freq_topn(spark: SparkSession, d: str) -> DataFrame:
    """The 500 commonest words: a top-k report."""
    return key_counts(spark, d).orderBy(F.desc("n"), "key").limit(500).select("key", "n")


@query(f"SELECT key, n, {normalize.rule_key_sql('key')} AS rule_key, regexp_replace(key, '^(.{{2,}}?)(?:{'|'.join(text.SUFFIXES)})$', '\\1') AS stem FROM (SELECT key, count(*) AS n FROM ({KEYS_SQL}) WHERE key <> '' GROUP BY key)")
def word_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct word with its count, its key for the rule engine's tables and its stem."""
    return key_counts(spark, d).select("key", "n", normalize.rule_key(F.col("key")).alias("rule_key"), text.stem(F.col("key")).alias("stem"))


# --- normal forms -----------------------------------------------------------------------------------
@query(f"SELECT doc_id, {normalize.rule_text_sql('text')} AS form FROM documents")
def norm_rule(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normalize.rule_text(F.col("text")).alias("form"))


@query(f"SELECT test_id, {normalize.scheme_key_sql('urdu')} AS form, {normalize.scheme_key_sql('urdu', True)} AS marked, {normalize.line_key_sql('urdu')} AS line_key FROM test")
def norm_scheme(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("urdu")
    return table(spark, d, "test").select("test_id", normalize.scheme_key(u).alias("form"), normalize.scheme_key(u, True).alias("marked"), normalize.line_key(u).alias("line_key"))


@query(f"SELECT DISTINCT word, {normalize.word_key_sql('word')} AS form FROM (SELECT unnest(string_split_regex(src, '[{B}\\n]+')) AS word FROM train) WHERE word <> ''")
def norm_word(spark: SparkSession, d: str) -> DataFrame:
    """Words of the training rows as the line model keys them."""
    words = table(spark, d, "train").select(F.explode(text.words(F.col("src"))).alias("word")).distinct()
    return words.select("word", normalize.word_key(F.col("word")).alias("form"))


@query(f"SELECT DISTINCT result_id, {normalize.ocr_text_sql('text')} AS form, {normalize.ocr_text_sql('text', 'urdu', True)} AS urdu_digits FROM ocr_results WHERE text IS NOT NULL")
def norm_ocr(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ocr_results").where("text IS NOT NULL").select("result_id", "text").distinct()
    return rows.select("result_id", normalize.ocr_text(F.col("text")).alias("form"), normalize.ocr_text(F.col("text"), "urdu", True).alias("urdu_digits"))


def sql_punct(x: str, folds: dict[str, str]) -> str:
    return normalize.mapped_sql(x, folds)


_LINE = {"٪": "%", "ء": ""} | C.digits(C.ARABIC_DIGITS, C.URDU_DIGITS)


@query(f"SELECT test_id, {sql_punct('urdu', C.PUNCT_DEVA)} AS devanagari, {sql_punct('urdu', C.PUNCT_ROMAN)} AS roman, {sql_punct('urdu', C.PUNCT_ROMAN | _LINE)} AS line FROM test")
def punct_render(spark: SparkSession, d: str) -> DataFrame:
    """Punctuation by script; digits and the per cent sign as the line engine writes them."""
    u = F.col("urdu")
    return table(spark, d, "test").select("test_id", text.punct(u, C.PUNCT_DEVA).alias("devanagari"), text.punct(u, C.PUNCT_ROMAN).alias("roman"), text.line_punct(u, C.PUNCT_ROMAN).alias("line"))


@query(f"SELECT regexp_extract(tok, '^[{P}]*') AS prefix, CASE WHEN regexp_full_match(tok, '[{P}]+') THEN '' ELSE regexp_extract(tok, '[{P}]*$') END AS suffix, count(*) AS n FROM ({TOKENS_SQL}) WHERE regexp_full_match(tok, '{RUN}') GROUP BY ALL")
def token_edges(spark: SparkSession, d: str) -> DataFrame:
    """Which marks stand at the edges of Urdu runs, and how often."""
    t = lookup.tokens(table(spark, d, "documents"), "doc_id", "text").where("is_word").select(text.peel(F.col("tok")).alias("p"))
    return t.groupBy("p.prefix", "p.suffix").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT result_id, list_filter(string_split_regex(lower(regexp_replace(roman, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]', ' ', 'g')), '[{B}\\n]+'), lambda x: x <> '') AS words FROM translit_results WHERE roman IS NOT NULL")
def scoring_words(spark: SparkSession, d: str) -> DataFrame:
    """Roman answers as the scorer splits them."""
    return table(spark, d, "translit_results").where("roman IS NOT NULL").select("result_id", text.plain_words(F.col("roman")).alias("words")).distinct()


# --- folds ------------------------------------------------------------------------------------------
@query(f"SELECT fold, count(DISTINCT roman) AS spellings, count(*) AS n FROM (SELECT roman, {fold.fold_roman_sql('roman')} AS fold FROM (SELECT DISTINCT result_id, roman FROM translit_results WHERE roman IS NOT NULL)) GROUP BY fold")
def latin_fold_key(spark: SparkSession, d: str) -> DataFrame:
    """Folded Roman answers: how many spellings fall together."""
    rows = table(spark, d, "translit_results").where("roman IS NOT NULL").select("result_id", "roman").distinct()
    return rows.groupBy(fold.fold_roman(F.col("roman")).alias("fold")).agg(F.count_distinct("roman").alias("spellings"), F.count("*").alias("n"))


@query(f"SELECT test_id, {fold.fold_hindi_sql('deva')} AS hindi, {fold.fold_gold_sql('deva')} AS gold FROM test")
def deva_fold_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "test").select("test_id", fold.fold_hindi(F.col("deva")).alias("hindi"), fold.fold_gold(F.col("deva")).alias("gold"))


@query()
def deva_convention_keys(spark: SparkSession, d: str) -> DataFrame:
    """The other comparison keys of Devanagari (no SQL twin: they decompose first)."""
    v = F.col("deva")
    named = {"plain": fold.fold_deva(v), "without_izafat": fold.fold_deva(v, False), "conventions": fold.fold_conventions(v), "nasals": fold.fold_nasals(v), "homorganic": fold.homorganic_nasals(v), "line": fold.line_nasals(v)}
    return table(spark, d, "test").select("test_id", *[c.alias(n) for n, c in named.items()])


_SOUND_SQL = normalize.mapped_sql(f"regexp_replace(replace(urdu, 'ی{C.KHARI_ZABAR}', 'ا'), 'ہ$', 'ا')", fold.SAME_SOUND)


@query(f"SELECT item_id, {_SOUND_SQL} AS sound, translate({_SOUND_SQL}, 'اوی', '') AS skeleton FROM (SELECT DISTINCT item_id, urdu FROM translit_items)")
def sound_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "translit_items").select("item_id", "urdu").distinct()
    return rows.select("item_id", fold.sound(F.col("urdu")).alias("sound"), fold.sound_skeleton(F.col("urdu")).alias("skeleton"))


@query()
def roman_loose_keys(spark: SparkSession, d: str) -> DataFrame:
    """Looser keys of Roman (no SQL twin: back references)."""
    r = F.col("rich")
    return table(spark, d, "test").select("test_id", fold.loose_roman(r).alias("loose"), fold.loosest_roman(r).alias("loosest"), fold.degeminated(r).alias("degeminated"), fold.alignment_fold(r).alias("alignment"))


# --- tests on rows ----------------------------------------------------------------------------------
_ONLY_ARABIC = "len(regexp_extract_all(src, '[ةىيك]')) > 2"
_WORDISH = f"(regexp_full_match(src, '{RUN}') AND len(regexp_extract_all(src, '[{C.URDU_LETTERS}]')) >= 2 AND NOT contains(src, '،')) OR src IN ('ء', 'و', 'ع', 'آ')"


@query(
    "SELECT train_id, regexp_matches(src, '[\\x{600}-\\x{6FF}]') AS has_urdu, "
    f"regexp_full_match(src, '[{C.URDU_LETTERS}{C.HARAKAT}{C.KHARI_ZABAR}{C.HAMZA_ABOVE}]+') AS urdu_word, regexp_full_match(tgt, '[a-z]+') AS casual, regexp_full_match(tgt, '[\\x{{900}}-\\x{{97F}}]+') AS devanagari, "
    f"{_ONLY_ARABIC} AS arabic, {_WORDISH} AS dictionary_word, regexp_full_match(src, '[^{B}\\n_]{{2,}}') AS title_word, regexp_matches(tgt, '[\\x{{600}}-\\x{{6FF}}]') AS leaks, length(src) <= 40 AND length(tgt) <= 60 AS short_enough, "
    "CASE WHEN regexp_matches(tgt, '[,~/()0-9;:\\[\\]{}<>=+*&%$#@|\\\\\"]') THEN true ELSE false END AS alternatives, coalesce(origin = 'silver' AND weight < 0.5, false) AS low_score FROM (SELECT DISTINCT train_id, src, tgt, origin, weight FROM train WHERE src IS NOT NULL AND tgt IS NOT NULL)"
)
def predicate_profile(spark: SparkSession, d: str) -> DataFrame:
    """What each training row is: the tests that the builders filter by."""
    s, t = F.col("src"), F.col("tgt")
    rows = table(spark, d, "train").where("src IS NOT NULL AND tgt IS NOT NULL").select("train_id", "src", "tgt", "origin", "weight").distinct()
    named = {
        "has_urdu": text.has_urdu(s), "urdu_word": text.is_urdu_word(s), "casual": text.is_casual_roman(t), "devanagari": text.is_devanagari(t), "arabic": text.is_arabic(s),
        "dictionary_word": text.is_dictionary_word(s), "title_word": text.is_title_word(s), "leaks": text.leaks(t), "short_enough": (F.length(s) <= 40) & (F.length(t) <= 60),
        "alternatives": text.has_alternatives(t), "low_score": F.coalesce((F.col("origin") == "silver") & (F.col("weight") < 0.5), F.lit(False)),
    }
    return rows.select("train_id", *[c.alias(n) for n, c in named.items()])


@query("SELECT DISTINCT task, src, tgt FROM train WHERE length(src) <= 40 AND length(tgt) <= 60 AND NOT coalesce(origin = 'silver' AND weight < 0.5, false)")
def length_guards(spark: SparkSession, d: str) -> DataFrame:
    """Training rows within the model's lengths, without low-scored ones; a missing score is none."""
    low = F.coalesce((F.col("origin") == "silver") & (F.col("weight") < 0.5), F.lit(False))
    return table(spark, d, "train").where((F.length("src") <= 40) & (F.length("tgt") <= 60) & ~low).select("task", "src", "tgt").distinct()


@query("SELECT side, c, count(*) AS n FROM (SELECT 'src' AS side, unnest(regexp_extract_all(src, '(?s).')) AS c FROM train UNION ALL SELECT 'tgt', unnest(regexp_extract_all(tgt, '(?s).')) FROM train) GROUP BY side, c")
def vocab_chars(spark: SparkSession, d: str) -> DataFrame:
    """Characters of both sides of the training rows."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.regexp_extract_all(F.col(s), F.lit("(?s)."), F.lit(0)).alias("cs")) for s in ("src", "tgt")])).alias("x")
    return table(spark, d, "train").select(sides).select("x.side", F.explode("x.cs").alias("c")).groupBy("side", "c").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT label_id, substr(md5(ur), 1, 16) AS content_id, substr(md5(ur), 1, 16) = id AS agrees FROM teacher_labels WHERE ur IS NOT NULL")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    got = sets.content_id(F.col("ur"))
    return table(spark, d, "teacher_labels").where("ur IS NOT NULL").select("label_id", got.alias("content_id"), (got == F.col("id")).alias("agrees")).distinct()


# --- markup -----------------------------------------------------------------------------------------
def _entities(x: str) -> str:
    for k, v in text.ENTITIES.items():
        x = f"replace({x}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    return x


_BARE_SQL = _entities("regexp_replace(text, '<[^>]+>', '', 'g')")


@query(f"SELECT doc_id, trim(regexp_replace({_BARE_SQL}, '[{B}\\n]+', ' ', 'g')) AS plain FROM documents")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents without tags and entities, blanks single."""
    return table(spark, d, "documents").select("doc_id", text.strip_html(F.col("text")).alias("plain"))


def _markup_sql(x: str) -> str:
    steps = [(r"<ref[^>]*>.*?</ref>|<ref[^>]*/>", ""), (r"\{\{[^{}]*\}\}", ""), (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", r"\1"), (r"<[^>]+>|''{2,}|&nbsp;", " "), ("^[:*#; ]+", ""), (f"[{B}\\n]+", " ")]
    for a, b in steps:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return f"trim({x})"


@query(f"SELECT doc_id, line_no, {_markup_sql('line')} AS plain FROM ({sql_positions('doc_id', LINES_SQL, 'documents', 'line_no', 'line')})")
def markup_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every line of the documents without wiki markup."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", text.clean_markup(F.col("line")).alias("plain"))


#: Pages as the lexicon builder meets them: two languages, several headword marks, none.
PAGES = [
    (1, '<div class="mw-heading mw-heading2"><h2 id="Persian">P</h2></div><p>x</p><div class="mw-heading mw-heading2"><h2 id="Urdu">U</h2></div><p><span class="headword-line">w <span class="headword-tr tr Latn" lang="ur">kitāb</span></span></p>'),
    (2, '<div class="mw-heading mw-heading2"><h2 id="Urdu_2">U</h2></div><p><span class="headword-line">w <span lang="ur-Latn" class="mention-tr tr Latn">qalam</span></span></p>'),
    (3, '<div class="mw-heading mw-heading2"><h2 id="Hindi">H</h2></div><p><span class="headword-line">w <span class="headword-tr tr Latn">x</span></span></p>'),
    (4, '<div class="mw-heading mw-heading2"><h2 id="Urdu">U</h2></div><p>no headword</p>'),
    (5, None),
]


@query("SELECT * FROM (VALUES (1, 'kitāb'), (2, 'qalam'), (3, NULL), (4, NULL), (5, NULL)) t(page, romanisation)")
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    """Headword romanisations of a few pages (a golden: the SQL only lists what is right)."""
    pages = spark.createDataFrame(PAGES, "page int, html string")
    return pages.select("page", readers.headword(readers.language_section(F.col("html"))).alias("romanisation"))
