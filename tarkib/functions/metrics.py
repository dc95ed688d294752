"""Distances and likenesses of texts: native where Spark has them, bit-parallel in Arrow UDFs where it hasn't."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import words

#: Tokens are encoded as characters from here on for the word distance; so many distinct ones fit.
_FIRST, _FIT = 19968, 35_000


#: Longer texts are compared bit-parallel in Python, which takes a step for each letter of one of them only.
_LONG = 256


@F.pandas_udf(T.IntegerType())
def _long_errors(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def char_errors(ref: Column, hyp: Column) -> Column:
    """Edit distance of two texts of any length."""
    long_ = F.least(F.length(ref), F.length(hyp)) > _LONG
    return F.when(long_, _long_errors(F.when(long_, ref), F.when(long_, hyp))).otherwise(F.levenshtein(ref, hyp))


def _rate(errors: Column, size: Column, hyp_size: Column) -> Column:
    return F.when(size == 0, F.when(hyp_size == 0, 0.0).otherwise(1.0)).otherwise(errors / size)


def cer(ref: Column, hyp: Column) -> Column:
    """Edit distance by the reference's length; of an empty reference 0 if the hypothesis is empty, else 1."""
    return _rate(char_errors(ref, hyp), F.length(ref), F.length(hyp))


@F.pandas_udf(T.IntegerType())
def _many_errors(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


def token_errors(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words: each distinct word is one character for ``levenshtein``."""

    def coded(x: Column, known: Column) -> Column:
        return F.array_join(F.transform(x, lambda t: F.decode(F.unhex(F.hex(F.lit(_FIRST) + F.array_position(known, t))), "UTF-16BE")), "")

    # one element to bind the arrays to, which would else be made anew for every word
    bound = F.array(F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("k")))
    short = F.get(F.transform(bound, lambda s: F.levenshtein(coded(s["a"], s["k"]), coded(s["b"], s["k"]))), 0)
    fits = F.least(F.size(a), F.size(b)) <= _LONG
    small = fits & (F.size(a) + F.size(b) < _FIT)
    return F.when(small, short).when(a.isNotNull() & b.isNotNull(), _many_errors(F.when(~small, a), F.when(~small, b)))


def wer(ref: Column, hyp: Column) -> Column:
    r, h = words(ref), words(hyp)
    return _rate(token_errors(r, h), F.size(r), F.size(h))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; two empty texts are alike."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


# --- sequences ------------------------------------------------------------------------------------
def _masks(a: Sequence) -> dict:
    out: dict = {}
    for i, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << i
    return out


def lcs(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, all of ``a`` at once for each item of ``b``."""
    full, seen = (1 << len(a)) - 1, _masks(a)
    row = full
    for y in b:
        hit = row & seen.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def distance(a: Sequence, b: Sequence) -> int:
    """Edit distance, bit-parallel over ``a``."""
    if not a:
        return len(b)
    seen, top, full = _masks(a), 1 << len(a) - 1, (1 << len(a)) - 1
    up, down, score = full, 0, len(a)
    for y in b:
        eq = seen.get(y, 0)
        diag = ((eq & up) + up ^ up | eq | down) & full
        plus, minus = (down | ~(diag | up)) & full, up & diag
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = (minus | ~(diag | plus)) & full, plus & diag
    return score


def likeness(a: str, b: str) -> float:
    most = max(len(a), len(b))
    return 1.0 if most == 0 else 1 - distance(a, b) / most


def indel(a: str, b: str) -> float:
    """Twice the common subsequence by both lengths, in per cent; two empty texts are 100."""
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def _pairwise(f, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run


indel_ratio = _pairwise(indel, T.DoubleType())
#: Longest matching blocks, as difflib finds them.
block_ratio = _pairwise(lambda x, y: difflib.SequenceMatcher(None, x, y).ratio(), T.DoubleType())
common_tokens = _pairwise(lambda x, y: lcs(list(x), list(y)), T.IntegerType())

_PAIRS = T.ArrayType(T.StructType([T.StructField("ours", T.StringType()), T.StructField("gold", T.StringType())]))


def differing(got: Sequence[str], want: Sequence[str]) -> list[tuple[str, str]]:
    """What differs between two lines of words: word by word where as many stand against each other."""
    out: list[tuple[str, str]] = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, list(got), list(want), autojunk=False).get_opcodes():
        if kind != "equal":
            out += zip(got[i:j], want[k:m], strict=True) if j - i == m - k else [(" ".join(got[i:j]), " ".join(want[k:m]))]
    return out


differences = _pairwise(differing, _PAIRS)
