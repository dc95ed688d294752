"""What the operators of this subpackage share: reading tables, cutting lineage, folding text."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle, whatever size Spark gives it: that size follows the files, not the rows and texts that a
    function made of them, so that a table of gigabytes may be taken for one to broadcast."""
    return df.hint("merge")


#: A table of bits has so many words of 64 bits: 4 MB, whatever it stands for.
BIT_WORDS = 1 << 18


def bit_filtered(df: DataFrame, key: str, among: DataFrame, other: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` (bigint) may be among ``other``: none that is gets lost, some that aren't pass, more
    the more there are. What is broadcast has a fixed size; an exact join follows, with less to shuffle."""

    def word(c: str) -> Column:
        return F.pmod(F.col(c), F.lit(BIT_WORDS))

    def mask(c: str) -> str:
        return f"shiftleft(1L, cast(pmod(shiftright({c}, 18), 64) as int))"

    bits = among.groupBy(word(other).alias("_word")).agg(F.expr(f"bit_or({mask(other)})").alias("_bits"))
    return df.withColumn("_word", word(key)).join(F.broadcast(bits), "_word").where(f"_bits & {mask(key)} <> 0").drop("_word", "_bits")


# --- Fixed values: characters that look the same to a reader -----------------------------------
#: Letters of the Arabic keyboard layout and the Urdu letter of the same shape or sound.
URDU_LETTERS = {"ي": "ی", "ى": "ی", "ك": "ک", "ه": "ہ", "ە": "ہ", "ڪ": "ک", "ې": "ی"}
#: Arabic-Indic digits whose shape is that of the Urdu digit (4, 5 and 6 differ in shape).
URDU_DIGITS = {"٠": "۰", "١": "۱", "٢": "۲", "٣": "۳", "٧": "۷", "٨": "۸", "٩": "۹"}
#: Cyrillic and Greek letters of the same shape as a Latin one.
LATIN_SHAPES = dict(
    zip(
        "АВЕЅІЈКМНОРСТХУаеоѕіјрсухΑΒΕΖΗΙΚΜΝΟΡΤΥΧο",
        "ABESIJKMHOPCTXYaeosijpcyxABEZHIKMNOPTYXo",
        strict=True,
    )
)
#: Hyphens that print the same.
HYPHENS = {"‐": "-", "‑": "-", "−": "-"}
#: Line ends other than \n.
LINE_ENDS = re.compile("\r\n|[\r\x85  ]")
#: Vowel signs of Urdu: harakat, superscript alef and the like. Hamza and madda are letters' parts.
VOWEL_MARKS = "".join(map(chr, [*range(0x064B, 0x0653), 0x0656, 0x0657, 0x0670, *range(0x0610, 0x061B)]))
KASHIDA = "ـ"
_SHAPES = str.maketrans(URDU_LETTERS | URDU_DIGITS | LATIN_SHAPES | HYPHENS)


@lru_cache(maxsize=1)
def invisible_class() -> str:
    """Body of a regex class of all characters that print nothing, taken from the Unicode categories."""
    out = [cp for cp in range(sys.maxunicode + 1) if unicodedata.category(chr(cp)) in ("Cf", "Cc") and chr(cp) not in "\n\t\r\x0b\x0c\x85"]
    out += [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
    return _body(set(out) - set(range(0x0600, 0x0606)) - {0x06DD, 0x070F, 0x08E2, 0x00AD})


def _body(points: Iterable[int]) -> str:
    runs: list[list[int]] = []
    for cp in sorted(set(points)):
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in runs)


_INVISIBLE = re.compile(f"[{invisible_class()}]")
_BLANKS = re.compile(r"[^\S\n]+")
_AROUND_BREAK = re.compile(r" ?\n ?")


def _settled(segment: str) -> str:
    """The one form of a segment that stands between boundaries."""
    t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", segment))
    if any(c in t for c in "ٕٓٔئؤۂۀۓأإآ"):
        return re.sub("کٔ+", "ک", unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).translate(_SHAPES)).replace("یٔ", "ئ"))
    return unicodedata.normalize("NFC", t.translate(_SHAPES))


def _changes(ch: str) -> bool:
    """Quick check of one character: No or Maybe, that is, it isn't its own one form or may join the one before it."""
    return _settled(ch) != ch or _settled("x" + ch + "x") != "x" + ch + "x" or unicodedata.combining(ch) not in (0, 7, 9)


#: Blocks whose stable characters are told from the rest; all others count as unstable, which costs time only.
_KNOWN = [*range(0x20, 0x7F), 0x0A, *range(0x0600, 0x0700), *range(0x0900, 0x0980), *range(0x2010, 0x2020)]


@lru_cache(maxsize=1)
def stable_points() -> frozenset[int]:
    return frozenset(cp for cp in _KNOWN if not _changes(chr(cp)))


def java_class(points: Iterable[int]) -> str:
    return re.sub(r"\\U0*([0-9A-F]+)", r"\\x{\1}", _body(points))


#: Nuktas join some letters and change places with a virama; after other letters they are stable. A virama after a mark
#: may change places too.
_LETTER = "\u0915-\u0927\u092A-\u092F\u0932\u0935-\u0939"
_PLACED = f"(?<![{_LETTER}])\u093C|(?<![\u0904-\u0939\u093C])\u094D"
#: An unstable stretch: a letter that may be the base of what follows, then unstable characters and further marks.
_STRETCH = re.compile(f".?[\u093C\u094D]*(?:[^{_body(stable_points())}]|{_PLACED})(?:[^{_body(stable_points())}]|[\u093C\u094D])*", re.S)


def canon(text: str | None) -> str | None:
    """The one form of all texts that look alike; NULL stays NULL, a text of nothing visible is ''. Unstable stretches,
    each with the letter before it, are brought to their form and spliced into the unchanged text."""
    if text is None:
        return None
    t = _STRETCH.sub(lambda m: _form(m.group()), LINE_ENDS.sub("\n", text))
    return _AROUND_BREAK.sub("\n", _BLANKS.sub(" ", t)).strip(" \n")


@lru_cache(maxsize=100_000)
def _form(stretch: str) -> str:
    return _settled(stretch)


_DROP_MARKS = str.maketrans("", "", VOWEL_MARKS + KASHIDA)


@lru_cache(maxsize=65536)
def _kept(ch: str) -> str:
    kind = unicodedata.category(ch)
    if kind == "Nd":
        return str(unicodedata.digit(ch))
    return ch if kind[0] in "LNM" else ""


def letters(text: str | None, keep_blanks: bool = False) -> str | None:
    """Letters and digits of the canonical form, in lower case, without vowel marks, stretching strokes,
    punctuation and (unless kept) blanks; digits in ASCII."""
    c = canon(text)
    if c is None:
        return None
    c = c.translate(_DROP_MARKS).lower()
    return "".join([ch if keep_blanks and ch.isspace() else _kept(ch) for ch in c])


def words(text: str | None) -> list[str]:
    return (letters(text, True) or "").split()


def text_udf(f, kind: T.DataType | str = T.StringType()):
    """An Arrow UDF of a function of one text."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([f(x if isinstance(x, str) else None) for x in s], dtype=object)

    return run


canon_udf = text_udf(canon)
letters_udf = text_udf(letters)
