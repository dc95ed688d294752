"""Problem 1: same or nearly same records across splits.

Method: exact prefix-filter join of two sides. The rare shingles of the evaluation keys are the index; those of
the training keys probe it under length and position filters; what meets is verified by edit distance. Length and
position are part of the join key, in blocks, so that a shingle that a third of all rows have is split; a sketch of
the letters goes with each shingle, and pairs whose letters differ too much never leave the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, letters, shuffled, words

#: Least words of a text that may be matched nearly, and the share of letters that may differ.
WORDS = 6
DIFFER = 0.2
#: Frequencies of shingles are counted in so many buckets, and the index is announced to the probing side in
#: as many bits: both have a fixed size.
BUCKETS = 1 << 18
BITS = 1 << 22
#: Keys of at least LONG letters use shingles of four letters, keys under LONG / (1 - DIFFER) of two. Two keys
#: near enough always share one of these kinds.
LONG = 20


_KEYED = T.StructType([T.StructField("key", T.StringType()), T.StructField("words", T.IntegerType())])


@F.pandas_udf(_KEYED)
def _keyed(s: pd.Series) -> pd.DataFrame:
    rows = [(letters(x), len(words(x))) if isinstance(x, str) else (None, 0) for x in s]
    return pd.DataFrame(rows, columns=["key", "words"])


def keys(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, key, words): letters and digits of the canonical text, and its number of words. NULL ids and texts
    without letters or digits are left out; repeated rows count once."""
    got = df.select(F.col(f"`{row_id}`").alias("id"), _keyed(F.col(f"`{text}`")).alias("k"))
    return got.select("id", "k.key", "k.words").where("id IS NOT NULL AND key IS NOT NULL AND key <> ''").distinct()


def allowed(length: int) -> int:
    return int(DIFFER * length + 1e-9)


def prefix_size(length: int, q: int) -> int:
    """Shingles of a key of ``length`` letters that must be looked up, rarest first. A longer text of n letters
    keeps at least n - q + 1 - q * allowed(n) shingles; the least of that over all lengths it may meet counts."""
    grams = length - q + 1
    longest = int(length / (1 - DIFFER) + 1e-9)
    common = min(n - q + 1 - q * allowed(n) for n in range(length, longest + 1))
    return max(0, min(grams, grams - common + 1))


def _codes(key: str, q: int) -> np.ndarray:
    p = np.frombuffer(key.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = np.full(len(p) - q + 1, q, dtype=np.uint64)
    for i in range(q):
        h = (h ^ p[i : len(p) - q + 1 + i]) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _kinds(length: int) -> list[int]:
    return [4] * (length >= LONG) + [2] * (2 <= length < LONG / (1 - DIFFER) + 1)


def shingle_counts(keys_: DataFrame) -> np.ndarray:
    """How often shingles of each bucket occur in all keys."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            codes = [_codes(k, q) for k in b["key"] for q in _kinds(len(k))]
            if codes:
                total += np.bincount((np.concatenate(codes) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    got = keys_.mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[got["bucket"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out


# --- Fixed values: bits of a letter's count in the sketch, more for letters met more often. Only the strength of the
# filter depends on them, never a result.
_BITS_OF = {"ا": 8, "ی": 6, "ہ": 6, "ر": 5, "ن": 5, "و": 5, "ک": 5, "ے": 5, "م": 4, "ت": 4, "ل": 4, "س": 4, "ھ": 4} | dict.fromkeys("ںبدپجگ", 3)
_OTHERS, _OTHER_BITS = 15, 3
_FIRST_BIT = dict(zip(_BITS_OF, np.cumsum([0, *_BITS_OF.values()])[:-1].tolist(), strict=True))
_REST = sum(_BITS_OF.values())


def sketch(key: str) -> tuple[int, int]:
    """Counts of the letters of a key in unary, 128 bits. An edit changes at most one count upwards and one downwards, so
    keys within k edits differ in at most k bits each way."""
    bits = 0
    for ch in set(key):
        n = key.count(ch)
        if ch in _BITS_OF:
            bits |= ((1 << min(n, _BITS_OF[ch])) - 1) << _FIRST_BIT[ch]
    others: dict[int, int] = {}
    for ch in key:
        if ch not in _BITS_OF:
            others[ord(ch) % _OTHERS] = others.get(ord(ch) % _OTHERS, 0) + 1
    for slot, n in others.items():
        bits |= ((1 << min(n, _OTHER_BITS)) - 1) << (_REST + slot * _OTHER_BITS)
    low, high = bits & 0xFFFFFFFFFFFFFFFF, bits >> 64
    return low - (1 << 64) if low >> 63 else low, high - (1 << 64) if high >> 63 else high


def length_block(length: int) -> int:
    """Blocks of lengths, each a fifth wider than the one before: keys that may meet are in neighbouring blocks."""
    return int(np.log(length) / np.log(1 / (1 - DIFFER)) + 1e-9)


def _longest(block: int) -> int:
    return int((1 / (1 - DIFFER)) ** (block + 1) + 1)


def places(length: int, at: np.ndarray, probe: bool) -> list[tuple[int, np.ndarray]]:
    """(block of length, blocks of position) under which a shingle is looked up or, for the index, filed: the probe under
    its own, the index under every block that a key near enough could probe."""
    own = length_block(length)
    if probe:
        return [(own, at // max(1, allowed(_longest(own))))]
    out = []
    for block in (own - 1, own, own + 1):
        width = max(1, allowed(_longest(block)))
        reach = max(allowed(length), allowed(_longest(block)))
        low, high = (np.maximum(at - reach, 0)) // width, (at + reach) // width
        for step in range(int((high - low).max()) + 1 if len(at) else 0):
            out.append((block, np.where(low + step <= high, low + step, -1)))
    return out


_PREFIX = T.StructType([T.StructField(n, t) for n, t in (("g", T.LongType()), ("h", T.LongType()), ("n", T.IntegerType()), ("at", T.IntegerType()), ("s1", T.LongType()), ("s2", T.LongType()))])


def _placed(codes: np.ndarray, block: int, position: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = codes ^ np.uint64(((block + 2) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x + position.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))


def prefixes(keys_: DataFrame, counts, wanted=None) -> DataFrame:
    """(g, h, n, at, s1, s2): the rare shingles of each key, mixed with their blocks of length and position, the key's
    hash, length and sketch, and the shingle's place. ``wanted``: bits of what is worth probing; without, the index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        freq = counts.value
        bits = None if wanted is None else wanted.value
        for b in batches:
            out: list[tuple[np.ndarray, np.ndarray, int, int, int, int]] = []
            for h, key in zip(b["h"], b["key"], strict=True):
                s1, s2 = sketch(key)
                for q in _kinds(len(key)):
                    codes = _codes(key, q)
                    order = np.lexsort((np.arange(len(codes)), codes, freq[(codes % np.uint64(BUCKETS)).astype(np.int64)]))
                    order = order[: prefix_size(len(key), q)]
                    for block, position in places(len(key), order, bits is not None):
                        at = order[position >= 0]
                        g = _placed(codes[at], block, position[position >= 0])
                        if bits is not None:
                            c = g % np.uint64(BITS)
                            kept = (bits[(c >> np.uint64(3)).astype(np.int64)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 == 1
                            g, at = g[kept], at[kept]
                        if len(g):
                            out.append((g, at, h, len(key), s1, s2))
            sizes = [len(x[0]) for x in out]

            def spread(i: int, kind) -> np.ndarray:
                return np.repeat(np.array([x[i] for x in out], dtype=kind), sizes)

            yield pd.DataFrame(
                {
                    "g": np.concatenate([x[0] for x in out]).view(np.int64) if out else np.empty(0, dtype=np.int64),
                    "h": spread(2, np.int64),
                    "n": spread(3, np.int32),
                    "at": np.concatenate([x[1] for x in out]).astype(np.int32) if out else np.empty(0, dtype=np.int32),
                    "s1": spread(4, np.int64),
                    "s2": spread(5, np.int64),
                }
            )

    return keys_.mapInPandas(run, _PREFIX)


def index_bits(index: DataFrame) -> np.ndarray:
    """A bit for each shingle of the index, in a table of fixed size: one for each task, these joined in eight."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(BITS, dtype=bool)
        for b in batches:
            bits[(b["g"].to_numpy(dtype=np.int64).view(np.uint64) % np.uint64(BITS)).astype(np.int64)] = True
        yield pd.DataFrame({"bits": [np.packbits(bits, bitorder="little").tobytes()]})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(BITS // 8, dtype=np.uint8)
        for b in batches:
            for x in b["bits"]:
                out |= np.frombuffer(bytes(x), dtype=np.uint8)
        yield pd.DataFrame({"bits": [out.tobytes()]})

    marked = index.select("g").mapInPandas(mark, "bits binary")
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for r in marked.repartition(8).mapInPandas(join, "bits binary").collect():
        out |= np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


def near(a: Column, b: Column) -> Column:
    most = F.floor(F.greatest(F.char_length(a), F.char_length(b)) * F.lit(DIFFER) + F.lit(1e-9)).cast("int")
    return F.levenshtein(a, b) <= most


def near_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """(ka, kb): different keys of the two sides of which at most a fifth of the longer's letters differ."""
    sc = left.sparkSession.sparkContext
    a = left.select("key").distinct().withColumn("h", F.xxhash64("key"))
    b = right.select("key").distinct().withColumn("h", F.xxhash64("key"))
    counts = sc.broadcast(shingle_counts(a.select("key").unionByName(b.select("key"))))
    index = cut(prefixes(a, counts))
    bits = sc.broadcast(index_bits(index))
    probe = prefixes(b, counts, bits).select("g", *[F.col(c).alias(f"{c}2") for c in ("h", "n", "at", "s1", "s2")])
    most = F.floor(F.greatest("n", "n2") * F.lit(DIFFER) + F.lit(1e-9))

    def more(x: str, y: str) -> Column:
        """Bits of the one sketch that the other lacks."""
        return F.expr(f"bit_count(s1{x} & ~s1{y}) + bit_count(s2{x} & ~s2{y})")

    near_by = (F.abs(F.col("n") - F.col("n2")) <= most) & (F.abs(F.col("at") - F.col("at2")) <= most)
    met = shuffled(index).join(probe, "g").where(near_by & (more("", "2") <= most) & (more("2", "") <= most))
    met = met.select("h", "h2").distinct()
    pairs = met.join(shuffled(a.withColumnRenamed("key", "ka")), "h").join(shuffled(b.select(F.col("h").alias("h2"), F.col("key").alias("kb"))), "h2")
    return pairs.where("ka <> kb").where(near(F.col("ka"), F.col("kb"))).select("ka", "kb")


def overlaps(evaluation: DataFrame, training: DataFrame, eval_id: str, eval_text: str, train_id: str, train_text: str) -> DataFrame:
    """(a, b, exact): ids of all rows of the two sides that hold the same text: the same letters once
    look-alikes, vowel marks, stretching strokes, punctuation and blanks are set aside or, where both have at
    least WORDS words, an edit distance of at most DIFFER times the longer's letters. NULL and empty texts are
    no overlap. Work is done on distinct keys; rows are expanded at the end."""
    left, right = cut(keys(evaluation, eval_id, eval_text)), cut(keys(training, train_id, train_text))
    a, b = left.select(F.col("id").alias("a"), "key"), right.select(F.col("id").alias("b"), "key")
    same = shuffled(a).join(b, "key").select("a", "b", F.lit(True).alias("exact"))
    many = F.col("words") >= WORDS
    close = near_keys(left.where(many), right.where(many))
    a = left.where(many).select(F.col("id").alias("a"), F.col("key").alias("ka"))
    b = right.where(many).select(F.col("id").alias("b"), F.col("key").alias("kb"))
    return same.unionByName(close.join(shuffled(a), "ka").join(shuffled(b), "kb").select("a", "b", F.lit(False).alias("exact"))).distinct()


def report(evaluation: DataFrame, found: DataFrame) -> DataFrame:
    """(split, source, rows, exact, near, overlapping): evaluation rows of each split and source that overlap
    with training rows; ``found`` is that of ``overlaps``. NULL split or source is a group of its own."""
    hit = found.groupBy("a").agg(F.max("exact").alias("exact"), F.max(~F.col("exact")).alias("near"))
    rows = evaluation.select("test_id", "split", "source").distinct().join(hit, F.col("test_id") == F.col("a"), "left")
    return rows.groupBy("split", "source").agg(
        F.count("*").alias("rows"),
        F.count_if("exact").alias("exact"),
        F.count_if("near").alias("near"),
        F.count_if(F.col("exact").isNotNull()).alias("overlapping"),
    )
