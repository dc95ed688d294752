"""Scansion: the weights of a line's syllables and the meters it can be read in.

A weight is "-" long, "u" short, "-u" either, "x" a short that may be dropped. A line is an R text.
"""

from __future__ import annotations

import itertools
import math
import re
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_READINGS = 4096
_LONG = {"ā", "ī", "ū", "e", "o", "ai", "au"}
_SOUND = re.compile(r"(a[iu](?![aāiīuūeo])|[aāiīuūeo])|([kgcjṭḍtdpbṛ]h|[^\W\d_])")
_CHOICES = {"-": ("-",), "u": ("u",), "-u": ("-", "u"), "x": ("", "u")}


def _word(token: str) -> tuple[str, list[str]]:
    """The word's sounds and their kinds, V or C."""
    found = _SOUND.findall(re.sub("[~']", "", token))
    return "".join("V" if v else "C" for v, _ in found), [v or c for v, c in found]


def syllables(line: str) -> list[str]:
    tokens = [t for t in re.split("[ -]+", line.strip()) if t]
    words = [_word(t) for t in tokens]
    small = [t in ("e", "o") for t in tokens]
    for k in range(1, len(words)):  # a consonant goes over to the izafat or conjunction
        kinds, sounds = words[k - 1]
        if small[k] and kinds.endswith("C") and "V" in kinds:
            words[k] = ("C" + words[k][0], [sounds[-1], *words[k][1]])
            words[k - 1] = (kinds[:-1], sounds[:-1])
    out: list[str] = []
    for k, (kinds, sounds) in enumerate(words):
        ends_line = k == len(words) - 1
        drawn = not ends_line and kinds.endswith("C") and words[k + 1][0].startswith("V") and not small[k + 1]
        places = [m.start() for m in re.finditer("V", kinds)]
        for at, nxt in zip(places, [*places[1:], None], strict=True):
            last = nxt is None
            after = (len(kinds) if last else nxt) - at - 1
            coda = after if last else max(after - 1, 0)
            vowel = sounds[at]
            long_ = vowel in _LONG and not (vowel in "eo" and sounds[at + 1 : at + 2] == ["h"] and kinds[at + 2 : at + 3] == "C")
            extra = coda >= (1 if long_ else 2)
            weight = "-" if long_ or coda else "u"
            if long_ and not last and not after:
                weight = "-u"
            elif last and not coda and (long_ or small[k] or (vowel == "a" and len(places) > 1)):
                weight = "-u"
            elif last and drawn and not long_ and coda == 1:
                weight = "-u"
            out.append(weight)
            if extra:
                loose = drawn or ends_line if last else long_
                out.append("x" if loose else "u")
    return out


def readings(weights: list[str]) -> list[str]:
    """All meters the weights can be read in; none if there are more than ``MOST_READINGS``."""
    options = [_CHOICES[w] for w in weights]
    return ["".join(p) for p in itertools.product(*options)] if math.prod(map(len, options)) <= MOST_READINGS else []


def compatible(a: list[str], b: list[str]) -> bool:
    """Whether some meter fits both: the places that can be reached in both, step by step."""

    def skips(states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        todo = list(states)
        while todo:
            i, j = todo.pop()
            for nxt, free in (((i + 1, j), a[i : i + 1] == ["x"]), ((i, j + 1), b[j : j + 1] == ["x"])):
                if free and nxt not in states:
                    states.add(nxt)
                    todo.append(nxt)
        return states

    states = skips({(0, 0)})
    while states:
        if (len(a), len(b)) in states:
            return True
        states = skips({(i + 1, j + 1) for i, j in states if i < len(a) and j < len(b) and set(_CHOICES[a[i]]) & set(_CHOICES[b[j]]) - {""}})
    return False


def coded(weights: Column) -> Column:
    """The weights as a text of one letter each, "o" for either."""
    return F.array_join(F.transform(weights, lambda w: F.when(w == "-u", F.lit("o")).otherwise(w)), "")


def _bits(places: np.ndarray, words: int) -> np.ndarray:
    """A row of bits for each row of truth values, in words of 64."""
    out = np.zeros((len(places), words * 64), dtype=bool)
    out[:, : places.shape[1]] = places
    return np.packbits(out, axis=1, bitorder="little").view("<u8").astype(np.uint64, copy=False)


def fitting(a: list[str], b: list[str], n: np.ndarray) -> np.ndarray:
    """For each line of ``a`` the sum of ``n`` over the lines of ``b`` that are ``compatible``; lines are ``coded``. All
    lines of b are gone through at once: bit j of a line's state tells that its first j weights can be what was read of
    the line of a. Lines of a come in order, so that what they begin with alike is read once; lines of b are dropped once
    nothing can be read, and those of other lengths before."""
    out = np.zeros(len(a), dtype=np.int64)
    n = np.asarray(n, dtype=np.int64)
    most = np.array([len(x) for x in b], dtype=np.int64)
    least = most - np.array([x.count("x") for x in b], dtype=np.int64)

    def syllables_of(i: int) -> int:
        return len(a[i]) - a[i].count("x")

    order = sorted(range(len(a)), key=lambda i: (syllables_of(i), a[i]))
    for words in np.unique(most // 64 + 1).tolist():
        part = np.flatnonzero(most // 64 + 1 == words)
        width = max(1, int(most[part].max()))
        letter = np.array([b[i].encode() for i in part], dtype=f"S{width}").view(np.uint8).reshape(len(part), width)
        long_, short, either, loose = (letter == ord(c) for c in "-uox")
        may = {"-": _bits(long_ | either, words), "u": _bits(short | either | loose, words), "o": _bits(letter != 0, words), "x": _bits(short | either | loose, words)}
        skipped, end = _bits(loose, words), _bits(np.arange(width + 1) == most[part][:, None], words)
        runs = max((len(r) for i in part.tolist() for r in re.findall("x+", b[i])), default=0)

        def on(s: np.ndarray, words: int = words) -> np.ndarray:
            moved = s << np.uint64(1)
            if words > 1:
                moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            return moved

        def closed(s: np.ndarray, at: np.ndarray, skipped: np.ndarray = skipped, runs: int = runs) -> np.ndarray:
            loose_ = skipped.take(at, axis=0) if runs else skipped
            for _ in range(runs):
                s |= on(s & loose_)
            return s

        def true(s: np.ndarray, words: int = words) -> np.ndarray:
            return np.flatnonzero(s[:, 0] if words == 1 else s.any(axis=1))

        for syllables_, group in itertools.groupby(order, key=syllables_of):
            lines = list(group)
            at = np.flatnonzero((most[part] >= syllables_) & (least[part] <= max(len(a[i]) for i in lines)))
            first = np.zeros((len(at), words), dtype=np.uint64)
            first[:, 0] = 1
            stack, before = [(at, closed(first, at))], ""
            for i in lines:
                same = len(commonprefix([before, a[i]]))
                del stack[same + 1 :]
                for c in a[i][same:]:
                    at, s = stack[-1]
                    moved = closed(on(s & may[c].take(at, axis=0)), at)
                    if c == "x":
                        moved |= s
                    alive = true(moved)
                    stack.append((at.take(alive), moved.take(alive, axis=0)))
                at, s = stack[-1]
                out[i] += n[part[at.take(true(s & end.take(at, axis=0)))]].sum()
                before = a[i]
    return out


def pattern(weights: Column) -> Column:
    """The weights as a regular expression that the fitting meters match."""
    parts = F.transform(weights, lambda w: F.when(w == "-u", F.lit("[-u]")).when(w == "x", F.lit("u?")).otherwise(w))
    return F.concat(F.lit("^"), F.array_join(parts, ""), F.lit("$"))


def scans(weights: Column, meter: Column) -> Column:
    """Whether a line fits a meter, inside the JVM."""
    return F.regexp_like(meter, pattern(weights))


def support(lines: list[list[str]], weights: list[str], but: int | None = None) -> int:
    return sum(k != but and bool(x) and compatible(weights, x) for k, x in enumerate(lines)) if weights else 0


@F.pandas_udf(T.ArrayType(T.StringType()))
def line_weights(s: pd.Series) -> pd.Series:
    return pd.Series([syllables(x) if isinstance(x, str) else None for x in s], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def meters(w: pd.Series) -> pd.Series:
    return pd.Series([readings(list(x)) if x is not None else None for x in w], dtype=object)
