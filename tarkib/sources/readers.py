"""Readers of the file kinds that lexicons and corpora come in. Schemas are given, never inferred; a malformed row is
left out, not fatal; a missing file is empty where the caller says so."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize, text


def _lines(spark: SparkSession, path: str, optional: bool = False) -> DataFrame:
    """(value): the lines of text files, gzipped ones too."""
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        if optional and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "value string")
        raise


def separated(spark: SparkSession, path: str, columns: Sequence[str], separator: str = "\t", needed: int | None = None, optional: bool = False) -> DataFrame:
    """Columns of a separated file, trimmed and composed. Lines that begin with #, blank ones and those with fewer than
    ``needed`` columns or an empty one among them are left out; columns beyond are NULL where a line has none."""
    needed = len(columns) if needed is None else needed
    parts = F.transform(F.split("value", "\\Q" + separator + "\\E", -1), lambda x: F.trim(x))
    rows = _lines(spark, path, optional).where(~F.col("value").startswith("#")).select(parts.alias("p"))
    rows = rows.where((F.size("p") >= needed) & ~F.exists(F.slice("p", 1, needed), lambda x: x == ""))
    return rows.select(*[normalize.nfc(F.get("p", i)).alias(c) for i, c in enumerate(columns)])


def exact_dictionary(spark: SparkSession, path: str, optional: bool = True) -> DataFrame:
    """(urdu, devanagari, plain, marked) of a four-column dictionary; of several lines of a word the greatest counts."""
    rows = separated(spark, path, ("urdu", "devanagari", "plain", "marked"), optional=optional)
    best = rows.groupBy("urdu").agg(F.max(F.struct("devanagari", "plain", "marked")).alias("e"))
    return best.select("urdu", "e.*")


def fixes(spark: SparkSession, path: str, optional: bool = True) -> DataFrame:
    """(urdu, devanagari, rich, plain, marked) of a pipe-separated fixes file: '.' keeps, '-' drops."""
    return separated(spark, path, ("urdu", "devanagari", "rich", "plain", "marked"), "|", 2, optional)


def corrections(spark: SparkSession, path: str, optional: bool = True) -> DataFrame:
    """(key, devanagari, roman): a log of corrections, the newest line of each word. Lines of one file are numbered in
    order; several files follow each other by name."""
    log = _lines(spark, path, optional).select("value", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_at"))
    p = F.split("value", "\t")
    rows = log.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select("_file", "_at", F.trim(F.get(p, 0)).alias("urdu"), F.trim(F.get(p, 1)).alias("devanagari"), F.trim(F.get(p, 2)).alias("roman"))
    rows = rows.where("urdu <> '' AND devanagari <> ''").withColumn("key", normalize.word_key(F.col("urdu")))
    last = rows.groupBy("key").agg(F.max_by(F.struct("devanagari", "roman"), F.struct("_file", "_at")).alias("e"))
    return last.select("key", "e.devanagari", F.nullif("e.roman", F.lit("")).alias("roman"))


def _whole(spark: SparkSession, path: str, optional: bool) -> DataFrame:
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if optional and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "value string")
        raise


def lexicon(spark: SparkSession, path: str, key: str = "rule", optional: bool = True) -> DataFrame:
    """(key, devanagari, roman) of a JSON file {word: [devanagari, roman]}, gzipped or not. Entries of another form or
    with an empty value are left out. ``key``: rule or scheme, the normaliser of the keys."""
    table = F.explode(F.from_json("value", "map<string,array<string>>"))
    rows = _whole(spark, path, optional).select(table.alias("word", "v")).where("size(v) = 2 AND v[0] <> '' AND v[1] <> ''")
    made = {"rule": normalize.rule_key, "scheme": normalize.scheme_key}[key](F.col("word"))
    return rows.select(made.alias("key"), F.col("v")[0].alias("devanagari"), F.col("v")[1].alias("roman"))


def weights(spark: SparkSession, path: str, optional: bool = True) -> DataFrame:
    """(key, value, w) of a JSON file {word: {spelling: weight}}."""
    outer = F.explode(F.from_json("value", "map<string,map<string,double>>"))
    return _whole(spark, path, optional).select(outer.alias("key", "m")).select("key", F.explode("m").alias("value", "w"))


def listed(spark: SparkSession, path: str, optional: bool = True) -> DataFrame:
    """(key, value) of a JSON file {word: [value, ...]}, or {word: value}."""
    many = F.explode(F.from_json("value", "map<string,array<string>>"))
    one = F.explode(F.from_json("value", "map<string,string>"))
    whole = _whole(spark, path, optional)
    rows = whole.select(many.alias("key", "v")).select("key", F.explode_outer("v").alias("value"))
    flat = whole.select(one.alias("key", "value")).where("NOT startswith(value, '[')")
    return rows.where("value IS NOT NULL").unionByName(flat)


_ARRAYS = "map<string,array<string>>"
DISTILLED = f"lines {_ARRAYS}, words {_ARRAYS}, ctx {_ARRAYS}, joins {_ARRAYS}, merge {_ARRAYS}, future_merge map<string,array<double>>, o_join array<string>"


def distilled(spark: SparkSession, path: str, optional: bool = True) -> dict[str, DataFrame]:
    """The tables of a distilled JSON file, three scripts each (devanagari, plain, marked; NULL is no data): lines and
    words (key), context (side, a, b), joins and merge (a, b), future (key, rates)."""
    whole = _whole(spark, path, optional).select(F.from_json("value", DISTILLED).alias("t")).select("t.*")

    def scripts(v: str) -> list[Column]:
        return [F.get(F.col(v), i).alias(c) for i, c in enumerate(("devanagari", "plain", "marked"))]

    def keyed(name: str) -> DataFrame:
        return whole.select(F.explode(name).alias("key", "v"))

    def parts(n: int) -> Column:
        return F.get(F.split("key", "\t"), n)

    return {
        "lines": keyed("lines").select("key", *scripts("v")),
        "words": keyed("words").select("key", *scripts("v")),
        "context": keyed("ctx").select(parts(0).alias("side"), parts(1).alias("a"), parts(2).alias("b"), *scripts("v")),
        "joins": keyed("joins").select(parts(0).alias("a"), parts(1).alias("b"), *scripts("v")),
        "merge": keyed("merge").select(parts(0).alias("a"), parts(1).alias("b"), *scripts("v")),
        "future": keyed("future_merge").select("key", F.col("v").alias("rates")),
    }


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, last_by: str | None = None) -> DataFrame:
    """Rows of a JSON-lines file of a given schema; lines that are no JSON are left out. ``last_by``: only the last line
    of each value of that column."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    raw = _lines(spark, path).select("value", F.monotonically_increasing_id().alias("_at"))
    read = raw.select("_at", F.from_json("value", T.StructType([*kind.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    rows = read.where("r IS NOT NULL AND r._bad IS NULL").select("_at", *[f"r.{f.name}" for f in kind.fields])
    if last_by is not None:
        rest = [f.name for f in kind.fields if f.name != last_by]
        rows = rows.groupBy(last_by).agg(F.max_by(F.struct(*rest), "_at").alias("r")).select(last_by, "r.*").select(*kind.names)
        return rows
    return rows.drop("_at")


def zipped_json(spark: SparkSession, path: str, member: str, schema: T.StructType | str) -> DataFrame:
    """Rows of the JSON-lines members of ZIP files whose names match ``member``; a row's own file is read where it lies,
    one archive a task, a member line by line."""
    import fnmatch
    import io
    import zipfile

    def run(batches):
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if fnmatch.fnmatch(name, member):
                            with io.TextIOWrapper(z.open(name), "utf-8", "replace") as f:
                                for chunk in iter(lambda f=f: f.readlines(1 << 20), []):
                                    yield pd.DataFrame({"value": [x.rstrip("\r\n") for x in chunk]})

    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string")
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return lines.select(F.from_json("value", kind).alias("r")).where("r IS NOT NULL").select("r.*")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(line) of gzipped or plain text; a gzip file is one task, so ship many."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def separated_sentences(spark: SparkSession, path: str, end: str = "</s>") -> DataFrame:
    """(file, sentence, pos, urdu, roman): an aligned corpus, a word pair on each line, sentences ended by ``end``. Line
    order within a file is what Spark reads in order; the running count is by file, so ship many files."""
    rows = _lines(spark, path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("_at"), "value")
    by = Window.partitionBy("file").orderBy("_at")
    ended = F.col("value").contains(end)
    rows = rows.withColumn("sentence", F.coalesce(F.sum(ended.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pair = rows.where(~ended & F.col("value").contains("\t"))
    p = F.split("value", "\t")
    return pair.withColumn("pos", F.row_number().over(Window.partitionBy("file", "sentence").orderBy("_at")) - 1).select("file", "sentence", "pos", F.get(p, 0).alias("urdu"), F.get(p, 1).alias("roman"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of a label file: the path up to the first tab, then the text with whatever it holds."""
    p = F.split("value", "\t", 2)
    return _lines(spark, path).where(F.col("value").contains("\t")).select(F.get(p, 0).alias("file"), F.get(p, 1).alias("text"))


def images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(path, content) of image files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def key_file(path: str) -> dict[str, str]:
    """A small file of NAME=value lines; comments and blank lines left out, quotes taken off."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, eq, value = line.strip().partition("=")
            if eq and not name.startswith("#"):
                out[name.strip()] = value.strip().strip("'\"")
    return out


# --- pages ----------------------------------------------------------------------------------------
def language_section(html: Column, language: str = "Urdu") -> Column:
    """The first section of a page whose heading id begins with the language, up to the next heading of that level; ''
    where there is none."""
    head = '<div class="mw-heading mw-heading2"><h2 id="'
    body = F.regexp_extract(html, f"(?s){head}{language}[^\"]*\".*?</div>(.*?)(?={head}|\\z)", 1)
    return F.when(html.isNotNull(), body)


def headword(section: Column, window: int = 4000) -> Column:
    """The romanisation on a section's first headword line: within ``window`` characters and before the paragraph ends;
    the headword's own mark before any other Latin one. NULL where there is none."""
    at = F.instr(section, 'class="headword-line"')
    near = F.when(at > 0, F.substring_index(section.substr(at, F.lit(window)), "</p>", 1))
    own = F.regexp_extract(near, 'class="headword-tr tr Latn"[^>]*>([^<]*)<', 1)
    other = F.regexp_extract(near, 'lang="ur-Latn"[^>]*class="[^"]*tr Latn"[^>]*>([^<]*)<', 1)
    return F.nullif(F.trim(F.when(F.regexp_like(near, F.lit('class="headword-tr tr Latn"[^>]*>[^<]*<')), own).otherwise(other)), F.lit(""))


def poem_blocks(wikitext: Column) -> Column:
    """Lines of the poems of a wiki page as an array: markup cleaned, lines of other letters left out, '' for a break
    between stanzas."""
    blocks = F.regexp_extract_all(wikitext, F.lit(r"(?s)<poem[^>]*>(.*?)</poem>"), F.lit(1))
    lines = F.transform(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))), text.clean_markup)
    share = F.transform(lines, lambda x: F.struct(x.alias("x"), text.urdu_share(x).alias("s")))
    kept = F.filter(share, lambda e: e["s"].isNull() | (e["s"] >= 0.9))
    return F.transform(kept, lambda e: F.when(e["s"].isNull(), "").otherwise(e["x"]))


_UNIT = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())]))
VERSE = T.ArrayType(T.StructType([T.StructField("line", T.StringType()), T.StructField("units", _UNIT)]))


@F.pandas_udf(VERSE)
def verse_lines(pages: pd.Series) -> pd.Series:
    """Lines of a verse page with their words as its dictionary groups them: neighbouring spans of one id are one unit."""
    import html
    import re

    def plain(s: str) -> str:
        return " ".join(html.unescape(re.sub("<[^>]+>", "", s)).split())

    def units(p: str) -> list[dict]:
        out: list[dict] = []
        for key, inner in re.findall(r"<span(?: data-m='([^']*)')?[^>]*>(.*?)</span>", p, re.S):
            word = plain(inner)
            if word and key and out and out[-1]["id"] == key:
                out[-1]["text"] += " " + word
            elif word:
                out.append({"id": key, "text": word})
        return out

    def read(page: str | None) -> list[dict] | None:
        if not isinstance(page, str):
            return None
        part = re.search(r"<div class='pMC' data-roman='off'[^>]*>(.*?)(?=<div class='pMC'|\Z)", page, re.S)
        stanzas = re.findall(r"<div class='c'>(.*?)</div>", part.group(1), re.S) if part else []
        return [{"line": plain(p), "units": units(p)} for s in stanzas for p in re.findall(r"<p[^>]*>(.*?)</p>", s, re.S)]

    return pd.Series([read(x) for x in pages], dtype=object)


# --- what there is to label -------------------------------------------------------------------------
def label_items(poems: DataFrame, wiki: DataFrame, aligned: DataFrame, words: DataFrame, wiki_limit: int | None = None) -> DataFrame:
    """(src, grp, run): runs of Urdu words to label, each once with its least group. ``poems``: (title, line); ``wiki``:
    (line), only runs of several words and no Arabic quotations; ``aligned``: (split, line); ``words``: (word), single
    ones. ``wiki_limit`` takes the first so many wiki runs by text: a budget of the labeller."""
    from ..functions.runs import line_segments

    def runs(df: DataFrame, src: str, grp: Column, line: str) -> DataFrame:
        segs = F.explode(F.filter(line_segments(line), lambda s: s["kind"] == "u"))
        return df.select(F.lit(src).alias("src"), grp.alias("grp"), segs.alias("s")).select("src", "grp", F.col("s.text").alias("run"))

    from ..operators.sets import content_id

    many = F.col("run").contains(" ")
    from_wiki = runs(wiki.where(~text.is_arabic(F.col("line"))), "wiki", F.substring(content_id(F.col("line")), 1, 4), "line").where(many)
    if wiki_limit is not None:
        from_wiki = from_wiki.groupBy("src", "run").agg(F.min("grp").alias("grp")).orderBy("run").limit(wiki_limit)
    every = runs(poems, "poem", F.col("title"), "line").unionByName(from_wiki).unionByName(runs(aligned, "dak", F.col("split"), "line")).unionByName(runs(words, "word", F.lit(""), "word").where(~many))
    return every.groupBy("src", "run").agg(F.min("grp").alias("grp")).select("src", "grp", "run")


def sentence_corpus(texts: DataFrame, column: str, limit: int | None = None, least: int = 3, most: int = 18) -> DataFrame:
    """(sentence): Urdu sentences of ``least`` to ``most`` words, each once; the first ``limit`` by text, if any."""
    s = texts.select(F.explode(text.sentences(F.col(column))).alias("sentence"))
    s = s.where((text.urdu_share(F.col("sentence")) >= 0.6) & text.word_count_between(F.col("sentence"), least, most)).distinct()
    return s if limit is None else s.orderBy("sentence").limit(limit)


