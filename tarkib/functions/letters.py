"""Reading Urdu letter by letter: what a word without any table entry becomes in Devanagari and Roman.

One regex cuts the word into consonants with what they carry; the schwas that Roman leaves out are found by
another over the kinds of the pieces: C consonant, V vowel, S inherent schwa, X anything else.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import PUNCT_DEVA, PUNCT_ROMAN

# --- Fixed values: letters in Devanagari, plain Roman and, where it differs, marked Roman -------------
CONSONANTS = {
    "ب": ("ब", "b"), "پ": ("प", "p"), "ت": ("त", "t"), "ٹ": ("ट", "t", "ṭ"), "ث": ("स", "s"), "ج": ("ज", "j"), "چ": ("च", "ch"), "ح": ("ह", "h"),
    "خ": ("ख़", "kh", "ḳh"), "د": ("द", "d"), "ڈ": ("ड", "d", "ḍ"), "ذ": ("ज़", "z"), "ر": ("र", "r"), "ڑ": ("ड़", "r", "ṛ"), "ز": ("ज़", "z"),
    "ژ": ("झ़", "zh"), "س": ("स", "s"), "ش": ("श", "sh"), "ص": ("स", "s"), "ض": ("ज़", "z"), "ط": ("त", "t"), "ظ": ("ज़", "z"), "غ": ("ग़", "gh", "ġ"),
    "ف": ("फ़", "f"), "ق": ("क़", "q"), "ک": ("क", "k"), "گ": ("ग", "g"), "ل": ("ल", "l"), "م": ("म", "m"), "ن": ("न", "n"), "و": ("व", "v"),
    "ہ": ("ह", "h"), "ی": ("य", "y"),
}
ASPIRATES = {
    "ب": ("भ", "bh"), "پ": ("फ", "ph"), "ت": ("थ", "th"), "ٹ": ("ठ", "th", "ṭh"), "ج": ("झ", "jh"), "چ": ("छ", "chh"), "د": ("ध", "dh"),
    "ڈ": ("ढ", "dh", "ḍh"), "ک": ("ख", "kh"), "گ": ("घ", "gh"), "ر": ("ऱ्ह", "rh"),
}
FIRST_VOWELS = {"آ": ("आ", "aa", "ā"), "ا": ("अ", "a"), "ای": ("ई", "ee", "ī"), "او": ("ओ", "o"), "ع": ("अ", "a"), "ء": ("अ", "a")}
LONG_VOWELS = {"ا": ("ा", "aa", "ā"), "و": ("ो", "o"), "ی": ("ी", "i", "ī"), "ے": ("े", "e")}
MARKS = {"َ": ("a", "a"), "ِ": ("ि", "i"), "ُ": ("ु", "u"), "ْ": None}
ALONE = {"ں": ("ं", "n", "ñ", "X"), "ا": ("आ", "aa", "ā", "V"), "آ": ("आ", "aa", "ā", "V"), "ے": ("य", "y", "y", "C")}

_FIRST = re.compile("|".join(sorted(FIRST_VOWELS, key=len, reverse=True)))
_PIECE = re.compile(
    f"(?:([{''.join(ASPIRATES)}])ھ|([{''.join(CONSONANTS)}]))(ّ)?(?:([{''.join(MARKS)}])|([{''.join(LONG_VOWELS)}]))?|(.)", re.S
)
_SILENT = re.compile("S(?=CV|$)")


@lru_cache(maxsize=200_000)
def read_word(word: str, marked: bool = False) -> tuple[str, str]:
    """(Devanagari, Roman) of a word by its letters. Anything that isn't Urdu passes as it is; nothing Urdu stays."""

    def roman(entry: tuple) -> str:
        return entry[2] if marked and len(entry) > 2 else entry[1]

    deva: list[str] = []
    latin: list[str] = []
    kinds = ""

    def add(d: str, r: str, kind: str) -> None:
        nonlocal kinds
        deva.append(d)
        latin.append(r)
        kinds += kind

    first = _FIRST.match(word)
    if first:
        entry = FIRST_VOWELS[first.group()]
        add(entry[0], roman(entry), "V")
    for m in _PIECE.finditer(word, first.end() if first else 0):
        aspirate, plain, double, mark, long_, other = m.groups()
        if other is None:
            entry = ASPIRATES[aspirate] if aspirate else CONSONANTS[plain]
            d, r = entry[0], roman(entry)
            add(f"{d}्{d}" if double else d, r * (2 if double else 1), "C")
            if mark:
                if MARKS[mark]:
                    add(*MARKS[mark], "V")
            elif long_:
                add(LONG_VOWELS[long_][0], roman(LONG_VOWELS[long_]), "V")
            elif m.end() < len(word):
                add("", "a", "S")
        elif other in ALONE:
            add(ALONE[other][0], ALONE[other][2 if marked else 1], ALONE[other][3])
        elif other in PUNCT_DEVA:
            add(PUNCT_DEVA[other], PUNCT_ROMAN[other], "X")
        elif other != "ع" and not unicodedata.combining(other):
            add(other, other, "X")
    nucleus = min((i for i in (kinds.find("V"), kinds.find("S")) if i >= 0), default=len(kinds))
    for m in _SILENT.finditer(kinds):
        if m.start() > nucleus:
            latin[m.start()] = ""
    return "".join(deva), "".join(latin)


def mark_curated(urdu: str, roman: str) -> str:
    """A table's plain Roman in the marked style: doubled vowels long, n nasal where the Urdu ends so."""
    for a, b in (("aa", "ā"), ("ii|ee", "ī"), ("oo", "ū")):
        roman = re.sub(a, b, roman)
    return roman[:-1] + "ñ" if urdu.endswith("ں") and roman.endswith("n") else roman


READING = T.StructType([T.StructField(x, T.StringType()) for x in ("devanagari", "roman", "roman_marked")])


@F.pandas_udf(READING)
def read_letters(s: pd.Series) -> pd.DataFrame:
    """struct<devanagari, roman, roman_marked> of words; NULL gives NULLs."""
    rows = []
    for w in s:
        if isinstance(w, str):
            d, r = read_word(w)
            rows.append((d, r, read_word(w, True)[1]))
        else:
            rows.append((None, None, None))
    return pd.DataFrame(rows, columns=READING.names, dtype=object)
