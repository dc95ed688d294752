"""Problem 5: noise in the text of scanned pages.

Method: skip-gram vectors are learned from the lines. Rare words are linked by glyph edits to frequent ones of the book or
the dictionary; of these the one that fits the count and, by the vectors, the words around is taken for the printed one,
where other readings of the page don't tell. Furniture is told by the running title that recurs at the edges of a book's
pages; what is left is reflowed into paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import canon, canon_udf, cut
from .reading import distance, likeness

#: Least likeness of a line to the running title, least share of a book's pages that show it.
TITLE, SHOWN = 0.7, 0.1
#: Skip-gram vectors: most words that have one, numbers in it, words on either side; what a likeness of 1 to the context is
#: worth beside the logarithm of a word's count in the book.
VECTORS, SIZE, WINDOW = 50_000, 32, 3
CONTEXT = 2.0
#: Most occurrences of a misreading for each occurrence of the word in the book.
RATE = 0.02

# --- Fixed values ------------------------------------------------------------------------------
PAGE = "صفحہ"
HYPHENS = "-­¬=–"
_EDGES = "۔،؟!؛:()[]{}\"'«»“”‘’…—" + HYPHENS
_NUMBER = re.compile(r"[(\[\-–—*|\s]*([0-9۰-۹]+)[)\]\-–—*|\s]*")
_DECOR = re.compile(r"(?:^|(?<=\s))[(\[\-–—*|]*(?:[0-9۰-۹]+)?[)\]\-–—*|]*(?=\s|$)")
_LETTER = re.compile("[ؠ-ؿف-يٮ-ۓەۮ-ۯۺ-ۿ]")
_PURE = re.compile("[ؐ-ؚؠ-ٰٟ-ۓەۮ-ۯۺ-ۿ‌]+")
_YEAR = re.compile("[0-9۰-۹]+[ءھہ]")
#: Strokes that an engine takes for another letter.
STROKES = (("سـں", "ش"), ("ںـ", "س"))


def core(word: str) -> str:
    return word.strip(_EDGES)


def is_foreign(word: str) -> bool:
    """An Urdu word with a sign, letter or digit in it that isn't of its alphabet."""
    return bool(_LETTER.search(word)) and not _PURE.fullmatch(word) and not _YEAR.fullmatch(word)


def without_number(text: str) -> str:
    return " ".join(_DECOR.sub(" ", text).split())


def keys(word: str) -> list[str]:
    """Of a word and what one glyph edit, in a long word two, leaves of it."""
    n = len(word)
    drop = [word, *(word[:i] + word[i + 1 :] for i in range(n))] if n > 1 else [word]
    if n >= 6:
        drop += ["".join(c for k, c in enumerate(word) if k not in p) for p in combinations(range(n), 2)]
    return sorted(set(drop))


def glyph_edits(word: str, other: str) -> int:
    for a, b in STROKES:
        word = word.replace(a, b)
    return distance(word, other)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys(s: pd.Series) -> pd.Series:
    def mapped(w: str) -> str:
        for a, b in STROKES:
            w = w.replace(a, b)
        return w

    return pd.Series([keys(mapped(x)) for x in s], dtype=object)


@F.pandas_udf(T.IntegerType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([glyph_edits(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.StringType())
def _bare(s: pd.Series) -> pd.Series:
    return pd.Series([without_number(x) if isinstance(x, str) else None for x in s], dtype=object)


@F.pandas_udf(T.DoubleType())
def _like(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) if isinstance(x, str) and isinstance(y, str) and x else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


def placed(lines: DataFrame, results: DataFrame) -> DataFrame:
    """Each line once, in canonical form, with its page, its place from the top and from the foot, ``header`` and
    ``page_number``."""
    rows = lines.where("line_id IS NOT NULL").select("line_id", "result_id", "book_id", "line_no", "text", "conf").dropDuplicates(["line_id"])
    pages = results.where("page_id IS NOT NULL").select("result_id", "page_id").dropDuplicates(["result_id"])
    rows = rows.join(pages, "result_id", "left").withColumn("page", F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("r"), "result_id"))).withColumn("text", F.coalesce(canon_udf("text"), F.lit("")))
    w = Window.partitionBy("result_id")
    rows = rows.withColumn("top", F.row_number().over(w.orderBy("line_no", "line_id")) - 1).withColumn("foot", F.row_number().over(w.orderBy(F.desc("line_no"), F.desc("line_id"))) - 1)
    rows = cut(rows.withColumn("bare", F.when((F.col("top") < 2) | (F.col("foot") < 2), _bare("text"))))
    size = rows.groupBy("book_id").agg(F.countDistinct("page").alias("size"))
    shown = rows.where("bare <> ''").groupBy("book_id", "bare").agg(F.countDistinct("page").alias("shown"), F.max((F.col("bare") == F.col("text")).cast("int")).alias("alone"))
    most = shown.where("alone = 1 AND shown >= 2").groupBy("book_id").agg(F.min(F.struct((-F.col("shown")).alias("less"), "bare")).alias("x"))
    titles = most.join(size, "book_id").where(-F.col("x.less") >= SHOWN * F.col("size")).select("book_id", F.col("x.bare").alias("title"))
    rows = rows.join(titles, "book_id", "left").withColumn("header", F.when(F.col("bare").isNotNull(), _like("bare", "title") >= TITLE).otherwise(False))
    number = F.col("text").rlike(f"^(?:{_NUMBER.pattern})$") | (_like("bare", F.lit(PAGE)) >= TITLE) & F.col("text").rlike(f"[0-9۰-۹][)\\]\\-–—*|\\s]*$")
    by_title = F.max(F.col("header").cast("int")).over(w.orderBy("top").rowsBetween(-1, 1)) == 1
    edge = (F.col("top") == 0) | (F.col("foot") == 0) | ((F.col("top") == 1) | (F.col("foot") == 1)) & by_title
    rows = rows.withColumn("page_number", F.col("bare").isNotNull() & ((F.col("header") & F.col("text").rlike(r"(?:^|\s)[(\[\-–—*|]*[0-9۰-۹]+[)\]\-–—*|]*(?:\s|$)")) | (number & edge)))
    return rows.select("line_id", "result_id", "book_id", "page", "line_no", "top", "text", "conf", "header", "page_number")


def _pairs(a: list[str], b: list[str]) -> list[str | None]:
    """For each word of ``a`` the word of ``b`` in its place, or NULL."""
    if a == b:
        return list(a)
    out: list[str | None] = [None] * len(a)
    for _, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if j - i == m - k:
            out[i:j] = b[k:m]
    return out


def _fit(a: Counter, b: Counter, longer: int) -> float:
    """Share of the longer line's words that both lines have."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    return sum(min(n, many[w]) for w, n in few.items() if w in many) / max(longer, 1)


def read_page(page: pd.DataFrame) -> pd.DataFrame:
    """The words of all readings of one page: how many readings have the word in its place, the word that most of the
    others have there and how many. ``part`` is 1 for the first and 2 for the second part of a broken word."""
    page = page.sort_values(["result_id", "top"])
    sheets: dict[int, list] = {}
    for r in page.itertuples(index=False):
        ws = r.text.split()
        cs = [core(w) for w in ws]
        sheets.setdefault(r.result_id, []).append((r, cs, ws, Counter(cs)))
    rows = []
    for rid, sheet in sheets.items():
        body = [i for i, (r, *_) in enumerate(sheet) if not (r.header or r.page_number)]
        after = dict(zip(body, body[1:], strict=False))
        broken = {i for i in body if i in after and sheet[i][2] and sheet[after[i]][2] and sheet[i][2][-1][-1] in HYPHENS and _LETTER.search(sheet[i][1][-1])}
        tail = {after[i] for i in broken}
        for i, (r, cs, ws, bag) in enumerate(sheet):
            seen = []
            for other, far in sheets.items():
                if other == rid:
                    continue
                if i < len(far) and far[i][1] == cs and cs:
                    seen.append(cs)
                    continue

                def fit(k: int, far=far, cs=cs, bag=bag) -> float:
                    return _fit(bag, far[k][3], max(len(cs), len(far[k][1])))

                k = i if i < len(far) and fit(i) >= 0.5 else max(range(len(far)), key=lambda k: (fit(k), len(cs) == len(far[k][1]), -abs(k - i)))
                alone = len(cs) == len(far[k][1]) and len(far) == len(sheet) and k == i
                if alone or fit(k) >= 0.5:
                    seen.append(_pairs(cs, far[k][1]))
            for p, c in enumerate(cs):
                votes = Counter(s[p] for s in seen if s[p])
                same = votes.pop(c, 0) + 1
                rest, n = min(votes.items(), key=lambda x: (-x[1], x[0])) if votes else (None, 0)
                part = 1 if i in broken and p == len(cs) - 1 else 2 if i in tail and p == 0 else 0
                whole = core(c + sheet[after[i]][1][0]) if part == 1 else core(sheet[body[body.index(i) - 1]][1][-1] + c) if part == 2 else c
                rows.append((r.line_id, r.book_id, r.page, r.line_no, p, ws[p], c, whole, part, same, rest, n))
    return pd.DataFrame(rows, columns=["line_id", "book_id", "page", "line_no", "pos", "stored", "word", "whole", "part", "same", "rest", "others"])


_WORDS = "line_id long, book_id string, page string, line_no int, pos int, stored string, word string, whole string, part int, same int, rest string, others int"


@F.pandas_udf(T.BooleanType())
def _foreign(s: pd.Series) -> pd.Series:
    return pd.Series([is_foreign(x) for x in s], dtype=bool)


def skip_grams(words: DataFrame, most: int = VECTORS) -> DataFrame:
    """(word, v): skip-gram vectors of the words as they stand in the lines of all books. Words so rare that more than
    ``most`` would have one get none: the driver and every task hold the vectors while they are learned."""
    sizes = words.where("whole <> '' AND part < 2").groupBy("whole").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    upto = Window.orderBy(F.desc("n"))  # one row for each count that occurs
    least = sizes.withColumn("sum", F.sum("c").over(upto)).where(F.col("sum") <= most).agg(F.min("n")).first()[0]
    spark = words.sparkSession
    if least is None:
        return spark.createDataFrame([], "word string, v array<double>")
    lines = words.where("whole <> '' AND part < 2").groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("pos", "whole"))).alias("x")).select(F.transform("x", lambda e: e["whole"]).alias("ws"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    model = Word2Vec(inputCol="ws", outputCol="v", vectorSize=SIZE, windowSize=WINDOW, minCount=max(2, int(least)), maxIter=1, numPartitions=min(parts, 32), seed=5)
    return model.fit(lines).getVectors().select("word", vector_to_array("vector").alias("v"))


def in_context(near: DataFrame, words: DataFrame) -> DataFrame:
    """``near`` (book_id, weak, printed) with ``context``: the likeness of the printed word's vector to those of the words
    around the weak one, 0 where either is unknown."""
    vectors = cut(skip_grams(words))
    weak = near.select("book_id", "weak").distinct()
    at = words.select("book_id", "line_id", "pos", F.col("whole").alias("weak")).join(weak, ["book_id", "weak"]).select("book_id", "weak", "line_id", F.col("pos").alias("at"))
    around = at.join(words.select("line_id", "pos", F.col("whole").alias("word")), "line_id").where((F.col("pos") != F.col("at")) & (F.abs(F.col("pos") - F.col("at")) <= WINDOW))
    sums = around.join(vectors, "word").select("book_id", "weak", F.posexplode("v").alias("i", "x")).groupBy("book_id", "weak", "i").agg(F.sum("x").alias("x"))
    mean = sums.groupBy("book_id", "weak").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("a"))
    both = near.join(mean, ["book_id", "weak"], "left").join(vectors.select(F.col("word").alias("printed"), F.col("v").alias("b")), "printed", "left")

    def dot(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)

    norm = F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b"))
    return both.withColumn("context", F.coalesce(F.when(norm > 0, dot("a", "b") / norm), F.lit(0.0))).drop("a", "b")


def judged(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The words of :func:`placed` lines with ``misread`` and the word that was likely printed."""
    words = rows.groupBy("page").applyInPandas(read_page, _WORDS)
    words = cut(words.withColumn("foreign", _foreign("word")))
    known = dictionary.select(canon_udf("urdu").alias("whole")).where("whole <> ''").distinct()
    vocab = words.where("whole <> '' AND part < 2").groupBy("book_id", "whole").agg(F.countDistinct("page", "line_no").alias("n"), F.max(F.col("foreign").cast("int")).alias("odd"))
    # in all books together as well: a word that many books have is none that is misread
    vocab = vocab.join(vocab.groupBy("whole").agg(F.sum("n").alias("all")), "whole")
    vocab = cut(vocab.join(known.withColumn("known", F.lit(True)), "whole", "left").withColumn("known", F.coalesce("known", F.lit(False))))
    urdu = F.col("whole").rlike(_LETTER.pattern)
    weak = vocab.where(~F.col("known") & urdu).select("book_id", F.col("whole").alias("weak"), F.col("n").alias("times"), F.col("all").alias("times_all"), F.explode(_keys("whole")).alias("key"))
    sound = vocab.where(urdu & (F.col("odd") == 0) & (F.col("known") | (F.col("n") >= 2)))
    near = weak.join(sound.select("book_id", F.col("whole").alias("printed"), "n", "all", F.explode(_keys("whole")).alias("key")), ["book_id", "key"]).select("book_id", "weak", "times", "times_all", "printed", "n", "all")
    # words of the dictionary that the book has nowhere else
    listed = known.join(vocab.groupBy("whole").agg(F.max("all").alias("all")), "whole", "left").select(F.col("whole").alias("printed"), F.lit(0).cast("long").alias("n"), F.coalesce("all", F.lit(0).cast("long")).alias("all"), F.explode(_keys("whole")).alias("key"))
    near = near.unionByName(weak.where("times = 1").join(listed, "key").select("book_id", "weak", "times", "times_all", "printed", "n", "all")).where("weak <> printed").groupBy("book_id", "weak", "times", "times_all", "printed").agg(F.max("n").alias("n"), F.max("all").alias("all"))
    near = near.where((F.col("times") == 1) | (F.col("times") <= RATE * F.col("n"))).where((F.col("times_all") <= 2) | (F.col("times_all") <= RATE * F.col("all"))).withColumn("edits", _edits("weak", "printed"))
    near = near.where((F.col("edits") <= 1) | (F.col("edits") == 2) & (F.length("weak") >= 6))
    near = in_context(near, words)
    fit = F.log1p("n") + CONTEXT * F.col("context")
    best = near.groupBy("book_id", F.col("weak").alias("whole")).agg(F.min(F.struct("edits", (-fit).alias("rank"), "printed")).alias("x")).select("book_id", "whole", F.col("x.printed").alias("printed"))
    strength = vocab.select("book_id", "whole", (F.col("n") + F.when(F.col("known"), 1_000_000).otherwise(0)).alias("strength"))
    out = words.join(strength, ["book_id", "whole"], "left").join(strength.select("book_id", F.col("whole").alias("rest"), F.col("strength").alias("rival")), ["book_id", "rest"], "left").join(best, ["book_id", "whole"], "left")
    zero = F.lit(0)
    outvoted = (F.col("others") > F.col("same")) | (F.col("others") == F.col("same")) & (F.coalesce("rival", zero) > F.coalesce("strength", zero))
    lone = (F.col("same") == 1) & (F.col("others") == 0) & F.col("printed").isNotNull()
    # of a broken word the part that differs
    lone = lone & F.when(F.col("part") == 1, ~F.col("printed").startswith(F.col("word"))).when(F.col("part") == 2, ~F.col("printed").endswith(F.col("word"))).otherwise(True)
    fixed = F.when(F.col("others") >= F.col("same"), F.col("rest")).when(F.col("part") == 0, F.col("printed"))
    return out.withColumn("misread", F.col("word").rlike(_LETTER.pattern) & (F.col("foreign") | outvoted | lone) | outvoted & F.col("rest").rlike(_LETTER.pattern)).withColumn("printed", F.when(F.col("misread"), fixed))


def found(lines: DataFrame, results: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(line_id, kind) for each kind of noise that a line shows. NULL ids are left out."""
    rows = cut(placed(lines, results))
    words = judged(rows, dictionary)
    kinds = [rows.where(k).select("line_id", F.lit(k).alias("kind")) for k in ("header", "page_number")]
    told = words.groupBy("line_id").agg(F.max(F.col("misread")).alias("misread"), F.max(F.col("part") == 1).alias("hyphen"))
    told = told.select("line_id", F.explode(F.array_compact(F.array(F.when(F.col("misread"), F.lit("misread")), F.when(F.col("hyphen"), F.lit("hyphen"))))).alias("kind"))
    return kinds[0].unionByName(kinds[1]).unionByName(told).distinct()


_HEADING = re.compile(r"\w+ [0-9۰-۹]+|[0-9۰-۹]+[ءھہ]?")


def reflow(lines: list[tuple[str, bool]]) -> str:
    """Paragraphs of a page from its lines without furniture, each with whether its last word is broken. A heading
    stands alone; a paragraph ends with a line that ends a sentence well before the usual width."""
    wide = sorted(len(t) for t, _ in lines)[len(lines) * 3 // 4] if lines else 0
    out, now = [], ""
    for text, broken in lines:
        if _HEADING.fullmatch(text):
            out, now = [*out, now, text], ""
            continue
        now += text.rstrip(HYPHENS) if broken else text + " "
        if not broken and text[-1:] in "۔؟!" and len(text) < 0.8 * wide:
            out, now = [*out, now], ""
    return "\n\n".join(" ".join(x.split()) for x in [*out, now] if x.strip())


def _page(page: pd.DataFrame) -> pd.DataFrame:
    best: dict[int, Counter] = {}
    for r in page.itertuples(index=False):
        best.setdefault(r.line_no, Counter())[(r.fixed, bool(r.broken))] += 1 + (r.conf if r.conf == r.conf and r.conf is not None else 0) / 1000
    lines = [max(sorted(best[k].items()), key=lambda x: x[1])[0] for k in sorted(best)]
    return pd.DataFrame([(page["page"].iloc[0], reflow([x for x in lines if x[0]]))], columns=["page", "text"])


def pages(lines: DataFrame, results: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(page, text): the paragraphs of each page, from all its readings; of a result without a page, r and its id."""
    rows = cut(placed(lines, results))
    shown = F.when(F.col("printed").isNotNull() & (F.col("word") != ""), F.expr("replace(stored, word, printed)")).otherwise(F.col("stored"))
    told = judged(rows, dictionary).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("w")))).alias("ws"), F.max(F.col("part") == 1).alias("broken"))
    kept = rows.where("NOT header AND NOT page_number").join(told, "line_id").select("page", "line_no", "conf", "broken", F.array_join("ws.w", " ").alias("fixed"))
    return kept.groupBy("page").applyInPandas(_page, "page string, text string")
