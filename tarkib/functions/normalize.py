"""The four normalisers, as native column expressions, and their SQL twins.

A key is only equal to another key that went through the same normaliser. NULL stays NULL and '' stays ''.
Composition (NFC) is the one step Spark has no expression for; only rows with a character that may compose
go through an Arrow UDF, all others stay in the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chars as C


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return pd.Series([unicodedata.normalize("NFC", x) if isinstance(x, str) else None for x in s], dtype=object)


@F.pandas_udf(T.StringType())
def _nfd(s: pd.Series) -> pd.Series:
    return pd.Series([unicodedata.normalize("NFD", x) if isinstance(x, str) else None for x in s], dtype=object)


def nfc(c: Column) -> Column:
    touched = c.rlike(C.MAY_COMPOSE)
    return F.when(touched, _nfc(F.when(touched, c))).otherwise(c)


def nfd(c: Column) -> Column:
    touched = c.rlike(r"[^\x00-\x7F]")
    return F.when(touched, _nfd(F.when(touched, c))).otherwise(c)


def mapped(c: Column, folds: dict[str, str]) -> Column:
    return F.translate(c, *C.pair(folds))


def mapped_sql(x: str, folds: dict[str, str]) -> str:
    a, b = C.pair(folds)
    return f"translate({x}, '{a}', '{b}')"


def blanks(c: Column) -> Column:
    """Runs of blanks to one, none around line breaks and at the ends; line breaks are structure and stay."""
    one = F.regexp_replace(F.regexp_replace(c, f"[{C.BLANK}]+", " "), " *\n *", "\n")
    return F.regexp_replace(one, r"^[ \n]+|[ \n]+$", "")


def blanks_sql(x: str) -> str:
    one = f"regexp_replace(regexp_replace({x}, '[{C.BLANK}]+', ' ', 'g'), ' *\\n *', chr(10), 'g')"
    return f"regexp_replace({one}, '^[ \\n]+|[ \\n]+$', '', 'g')"


# --- rule engine: hamza seats folded, vowel marks kept ------------------------------------------
_RULE = C.RULE_FOLDS | C.digits(C.ARABIC_DIGITS, C.URDU_DIGITS)


def rule_key(c: Column) -> Column:
    return mapped(nfc(c), _RULE)


def rule_key_sql(x: str) -> str:
    return mapped_sql(f"nfc_normalize({x})", _RULE)


def rule_text(c: Column) -> Column:
    return blanks(rule_key(c))


def rule_text_sql(x: str) -> str:
    return blanks_sql(rule_key_sql(x))


# --- scheme: hamza seats kept, vowel marks dropped ----------------------------------------------
_SCHEME = C.SCHEME_FOLDS | C.digits(C.ARABIC_DIGITS, C.URDU_DIGITS)
_BARE = _SCHEME | dict.fromkeys(C.HARAKAT, "")


def scheme_key(c: Column, keep_marks: bool = False) -> Column:
    return nfc(mapped(nfc(c), _SCHEME if keep_marks else _BARE))


def scheme_key_sql(x: str, keep_marks: bool = False) -> str:
    return f"nfc_normalize({mapped_sql(f'nfc_normalize({x})', _SCHEME if keep_marks else _BARE)})"


# --- line model: as scheme, without honorific signs, a word's last zer kept -----------------------
def word_key(c: Column) -> Column:
    plain = F.regexp_replace(nfc(c), f"[{C.HONORIFICS}]", "")
    bare = scheme_key(plain)
    return F.when((F.length(plain) > 1) & plain.endswith(C.ZER) & (bare != ""), F.concat(bare, F.lit(C.ZER))).otherwise(bare)


def word_key_sql(x: str) -> str:
    plain = f"regexp_replace(nfc_normalize({x}), '[\\x{{610}}-\\x{{61A}}]', '', 'g')"
    bare = scheme_key_sql(plain)
    return f"CASE WHEN length({plain}) > 1 AND suffix({plain}, '{C.ZER}') AND {bare} <> '' THEN {bare} || '{C.ZER}' ELSE {bare} END"


def phrase_key(c: Column) -> Column:
    """Key of a phrase: its words' keys without any zer at the end, single-spaced, nothing for empty words."""
    cleaned = F.regexp_replace(scheme_key(F.regexp_replace(nfc(c), f"[{C.HONORIFICS}]", "")), f"[{C.BLANK}\n]+", " ")
    return F.trim(cleaned)


def line_key(c: Column) -> Column:
    """Key of a verbatim line: scheme key with single blanks, line breaks included."""
    return F.trim(F.regexp_replace(scheme_key(c), f"[{C.BLANK}\n]+", " "))


def line_key_sql(x: str) -> str:
    return f"trim(regexp_replace({scheme_key_sql(x)}, '[{C.BLANK}\\n]+', ' ', 'g'))"


# --- OCR ------------------------------------------------------------------------------------------
def ocr_text(c: Column, digits: str = "ascii", fold_heh: bool = False) -> Column:
    """OCR output in Urdu letters. ``digits``: ascii, urdu or keep. Blank lines are dropped, also inside."""
    s = mapped(nfc(c), _ocr_folds(digits, fold_heh))
    s = F.replace(F.replace(s, F.lit("ﻻ"), F.lit("لا")), F.lit("ﻼ"), F.lit("لا"))
    s = F.regexp_replace(s, f"[{C.BLANK}]+", " ")
    s = F.regexp_replace(s, f" ([{C.NO_BLANK_BEFORE}])", "$1")
    return F.regexp_replace(F.regexp_replace(s, " *\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def ocr_text_sql(x: str, digits: str = "ascii", fold_heh: bool = False) -> str:
    s = mapped_sql(f"nfc_normalize({x})", _ocr_folds(digits, fold_heh))
    s = f"replace(replace({s}, 'ﻻ', 'لا'), 'ﻼ', 'لا')"
    s = f"regexp_replace({s}, '[{C.BLANK}]+', ' ', 'g')"
    s = f"regexp_replace({s}, ' ([{C.NO_BLANK_BEFORE}])', '\\1', 'g')"
    return f"regexp_replace(regexp_replace({s}, ' *\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


def _ocr_folds(digits: str, fold_heh: bool) -> dict[str, str]:
    out = C.OCR_FOLDS | ({"ه": "ہ"} if fold_heh else {})
    if digits == "ascii":
        return out | C.digits(C.ARABIC_DIGITS, C.URDU_DIGITS)
    if digits == "urdu":
        return out | {d: C.URDU_DIGITS[i] for a in (C.ARABIC_DIGITS, C.ASCII_DIGITS) for i, d in enumerate(a)}
    if digits == "keep":
        return out
    raise ValueError(f"digits: ascii, urdu or keep, not {digits}")
