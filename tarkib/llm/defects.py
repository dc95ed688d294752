"""Problem 6: broken prompt and response pairs.

Method: readings are told from other answers by the likeness of consonant skeletons; copy, language, truncation
and loop checks label the rest; openings of what remains are clustered by verified MinHash, and a template that
recurs across unrelated prompts, and that reads nothing, reveals refusals. From the words of such answers those of
rarer wordings are known. No phrase is listed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, letters
from .graphs import components
from .reading import likeness, skeletons

#: Least likeness of a reading; true readings and others lie far on either side.
READING = 0.7
#: Prompts that an opening must answer to be a template, and its least share of the open answers of its verdict, so that
#: what is a template stays one, and only that, as the table grows.
PROMPTS = 3
SHARE = 0.0004
#: Most of a template's words that are words of readings; share of words of a script's readings above which a word of an
#: answer counts as one.
READ_WORDS = 0.75
#: Rounds in which the words of templates are learned; most that one word can say, in nats.
ROUNDS, MOST = 2, 3.0
SIMILAR = 0.8
OPENING = 8
BANDS, ROWS = 20, 4

def script(text: str) -> str:
    """deva, urdu or other: the script of most letters."""
    deva = sum("ऀ" <= c <= "ॿ" for c in text)
    urdu = sum("؀" <= c <= "ۿ" for c in text)
    rest = sum(c.isalpha() for c in text if not ("ऀ" <= c <= "ॿ" or "؀" <= c <= "ۿ"))
    return max((deva, "deva"), (urdu, "urdu"), (rest, "other"))[1]


def is_loop(words: list[str], due: int) -> bool:
    """The same run of words three times or more up to the end, the whole more than twice as long as due."""
    n = len(words)
    if n <= 2 * max(1, due):
        return False
    for p in range(1, n // 3 + 1):
        run = 0
        for j in range(n - 1, p - 1, -1):
            if words[j] != words[j - p] and not (j == n - 1 and words[j - p].startswith(words[j])):
                break
            run += 1
        if run >= 2 * p and run + p >= n / 2:
            return True
    return False


def is_start(part: list[str], whole: list[str]) -> bool:
    """``part`` reads the first words of ``whole``, at most two thirds of them; its last word may be cut."""
    if not part or len(part) > max(1, round(len(whole) * 2 / 3)):
        return False
    *full, last = part
    if any(likeness(a, b) < 0.5 for a, b in zip(full, whole, strict=False)) or likeness("".join(full), "".join(whole[: len(full)])) < READING:
        return False
    goal = whole[len(full)] if len(full) < len(whole) else ""
    return goal.startswith(last) or likeness(last, goal[: len(last)]) >= READING or likeness(last, goal) >= READING


@lru_cache(maxsize=20_000)
def _read(text: str) -> tuple[list[str], str]:
    s = skeletons(text)
    return s, "".join(s)


def judge(question: str | None, other: str | None, answer: str | None, wanted: str) -> str:
    """Defect of an answer in the script ``wanted`` to a question; '' for a reading, '?' for an answer in the
    right script and '!' for one in a wrong script that read nothing. ``other`` is another text whose reading
    will do as well, or NULL."""
    plain = letters(answer, True) or ""
    if not plain.strip():
        return "empty"
    sk, flat = _read(answer)
    ways = [_read(x) for x in (question, other) if isinstance(x, str) and (letters(x) or "")]
    like = max((likeness(flat, f) for _, f in ways), default=0.0)
    has = script(plain)
    if has != wanted:
        asked = letters(question) or ""
        if asked and has == script(asked) and (like >= READING or asked in letters(answer)):
            return "copy"
        return "language" if like >= READING else "!"
    ws = plain.split()
    if wanted == "deva" and is_loop(ws, max((len(s) for s, _ in ways), default=0)):
        return "loop"
    if like >= READING and (len(flat) > 2 or all(likeness(flat, f) == 1 for _, f in ways[:1])):
        return ""
    if like >= READING and len(ws) > 0 and any(len(s) == len(ws) for s, _ in ways):
        return ""
    if any(is_start(sk, s) for s, _ in ways) and any(len(ws) <= max(1, round(len(s) * 2 / 3)) and len(flat) < max(len(f), 1) for s, f in ways):
        return "truncated"
    return "?"


def _verdict(ur: str | None, hi: str | None, back: str | None) -> tuple[str, str, str | None]:
    found = judge(ur, None, hi, "deva")
    if found:
        return "hi", found, hi
    return "back", judge(hi, ur, back, "urdu"), back


def _shingles(opening: str) -> np.ndarray:
    s = {opening[i : i + 4] for i in range(max(1, len(opening) - 3))}
    return np.array(sorted(zlib.crc32(x.encode()) for x in s), dtype=np.uint64)


_A = np.random.default_rng(6).integers(1, 1 << 31, BANDS * ROWS).astype(np.uint64) * 2 + 1
_C = np.random.default_rng(9).integers(0, 1 << 62, BANDS * ROWS).astype(np.uint64)


def bands(opening: str) -> list[int]:
    """MinHash bands of the character shingles of an opening."""
    x = _shingles(opening)[:, None] * _A + _C
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    low = x.min(axis=0).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ low[:, k]) * np.uint64(0x100000001B3)
    return out.view(np.int64).tolist()


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bands(s: pd.Series) -> pd.Series:
    return pd.Series([bands(x) for x in s], dtype=object)


def _like(p: set[int], q: set[int]) -> bool:
    n = len(p & q)
    return n >= SIMILAR * (len(p) + len(q) - n)


def links(openings: DataFrame) -> DataFrame:
    """(u, v): verified links of distinct openings. In every MinHash band each is tried with all heads so far and is a head
    itself if it is like none. Bands are streamed in order, never gathered: a task keeps the heads of one band, which are
    unlike each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        band, heads = None, []
        for b in batches:
            rows = []
            for at, x in zip(b["band"], b["opening"], strict=True):
                if at != band:
                    band, heads = at, []
                p = set(_shingles(x).tolist())
                like = [h for h, q in heads if _like(p, q)]
                rows += [(x, h) for h in like]
                if not like:
                    heads.append((x, p))
            yield pd.DataFrame(rows, columns=["u", "v"])

    flat = openings.select("opening", F.explode(_bands("opening")).alias("band"))
    return flat.repartition("band").sortWithinPartitions("band", "opening").mapInPandas(run, "u string, v string").distinct()


def clusters(openings: DataFrame) -> DataFrame:
    """(opening, cluster) of distinct openings, connected by verified links."""
    named = openings.select("opening", F.xxhash64("opening").alias("node"))
    edges = links(openings).select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v"))  # told by 64 bits
    found = components(edges)
    return named.join(found, "node", "left").select("opening", F.coalesce("component", "node").alias("cluster"))


def read_words(judged: DataFrame, rows: DataFrame) -> DataFrame:
    """(word): words of the prompts and of answers that read them: what an answer that is a reading is made of."""
    plain = letters_words("text")
    faulty = judged.where("field = 'hi'").select("label_id").distinct()
    read = rows.join(faulty, "label_id", "left_anti").select(F.col("hi").alias("text"))
    texts = rows.select(F.col("ur").alias("text")).unionByName(read).where("text IS NOT NULL").distinct()
    return texts.select(F.explode(plain).alias("word")).distinct()


@F.pandas_udf(T.ArrayType(T.StringType()))
def letters_words(s: pd.Series) -> pd.Series:
    """Distinct words of texts, by letters and digits."""
    return pd.Series([sorted(set((letters(x, True) or "").split())) if isinstance(x, str) else [] for x in s], dtype=object)


def refusing(told: DataFrame, seeds: DataFrame) -> DataFrame:
    """(label_id, field) of the open answers made of the words of templates. ``told``: (label_id, field, kind, words);
    ``seeds``: (label_id, field) of answers that are templates. Each word's odds between templates and the other open
    answers of its kind are learned and the answers told by their sum, in a few rounds, as naive Bayes does."""
    words = cut(told.select("label_id", "field", "kind", F.explode("words").alias("word")))
    base = cut(told.select("label_id", "field", "kind").join(seeds.withColumn("seed", F.lit(True)), ["label_id", "field"], "left").withColumn("seed", F.coalesce("seed", F.lit(False))))
    now = base.withColumn("yes", F.col("seed"))
    for _ in range(ROUNDS):
        size = now.groupBy("kind").agg(F.count_if("yes").alias("ny"), F.count_if(~F.col("yes")).alias("nn"))  # one row a kind
        counts = words.join(now, ["label_id", "field", "kind"]).groupBy("kind", "word").agg(F.count_if("yes").alias("y"), F.count_if(~F.col("yes")).alias("n")).join(size, "kind")
        p = (F.col("y") + F.col("n")) / (F.col("ny") + F.col("nn"))
        odds = F.log((F.col("y") + p) / (F.col("ny") + 1)) - F.log((F.col("n") + p) / (F.col("nn") + 1))
        said = counts.where("ny > 0").select("kind", "word", F.least(F.greatest(odds, F.lit(-MOST)), F.lit(MOST)).alias("w"))
        score = words.join(said, ["kind", "word"]).groupBy("label_id", "field").agg(F.sum("w").alias("score"))
        now = cut(base.join(score, ["label_id", "field"], "left").withColumn("yes", F.col("seed") | (F.coalesce("score", F.lit(-1.0)) > 0)).drop("score"))
    return now.where("yes").select("label_id", "field")


_JUDGED = "label_id long, field string, verdict string, kind string, opening string, words array<string>, prompt string"


def defects(labels: DataFrame) -> DataFrame:
    """(label_id, field, defect), at most one row for each label_id, ``hi`` before ``back``. NULL ids are left
    out; repeated rows count once; of rows that share an id but not the content the first that is defective (by
    field, then defect, backwards) counts. A NULL or empty prompt makes every non-empty answer unrelated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                ur, hi, back = (x if isinstance(x, str) else None for x in (r.ur, r.hi, r.back))
                field, verdict, answer = _verdict(ur, hi, back)
                if not verdict:
                    continue
                ws = (letters(answer, True) or "").split() if verdict in "?!" else None
                rows.append((r.label_id, field, verdict, script(" ".join(ws)) if ws else None, " ".join(ws[:OPENING]) if ws else None, sorted(set(ws)) if ws else None, letters(ur) if ws else None))
            yield pd.DataFrame(rows, columns=["label_id", "field", "verdict", "kind", "opening", "words", "prompt"])

    rows = labels.where("label_id IS NOT NULL").select("label_id", "ur", "hi", "back").distinct()
    judged = cut(rows.mapInPandas(run, _JUDGED))
    pending = judged.where("opening IS NOT NULL").dropDuplicates(["label_id", "field", "opening"])
    told = cut(pending.join(clusters(pending.select("opening").distinct()), "opening"))
    # one prompt counts once; counted by (cluster, prompt) first, so that a hot template is combined before the shuffle
    each = told.groupBy("cluster", "kind", "prompt").agg(F.count("*").alias("n"), F.min("opening").alias("shown"))
    support = each.groupBy("cluster", "kind").agg(F.count("prompt").alias("prompts"), F.sum("n").alias("answers"), F.min("shown").alias("shown"))
    total = told.groupBy("kind").agg(F.count("*").alias("total"))
    often = cut(support.join(total, "kind").where((F.col("prompts") >= PROMPTS) & (F.col("answers") >= SHARE * F.col("total"))))
    # a reading of another text recurs too, but its words are those of readings
    spelled = often.select("cluster", "kind", F.explode(F.split("shown", " ")).alias("word"))
    known = read_words(judged, rows).join(spelled.select("word").distinct(), "word", "left_semi").withColumn("known", F.lit(1))
    share = spelled.join(known, "word", "left").groupBy("cluster", "kind").agg(F.avg(F.coalesce("known", F.lit(0))).alias("known"))
    templates = share.where(F.col("known") <= READ_WORDS).select("cluster", "kind")
    seeds = told.join(templates, ["cluster", "kind"], "left_semi").select("label_id", "field").distinct()
    refused = refusing(told.select("label_id", "field", "kind", "words"), seeds).withColumn("refused", F.lit(True)).distinct()
    kind = F.when(F.col("refused"), "refusal").when(F.col("verdict") == "!", "language").otherwise("unrelated")
    opened = told.join(refused, ["label_id", "field"], "left").select("label_id", "field", kind.alias("defect"))
    plain = judged.where("opening IS NULL").select("label_id", "field", F.col("verdict").alias("defect"))
    best = plain.unionByName(opened).groupBy("label_id").agg(F.max(F.struct("field", "defect")).alias("x"))
    return best.select("label_id", "x.field", "x.defect")
