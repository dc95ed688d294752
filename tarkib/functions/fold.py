"""Comparison keys: what two spellings may differ in without being different, as native column expressions.

NULL stays NULL. Each key has an SQL twin where the queries need one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import chars as C
from .normalize import nfc, nfd

_CONSONANT = "[क-ह]"


def _replaced(c: Column, pairs: dict[str, str]) -> Column:
    for a, b in pairs.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _replaced_sql(x: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


# --- Roman ----------------------------------------------------------------------------------------
#: Spellings of one sound in typed Roman, in the order in which they are levelled.
_LEVEL = {"w": "v", "chh": "ch", "ee": "i", "oo": "u"}
_AFTER = {"ein": "en", "ain": "an"}
_LOOSE = {"q": "k", "x": "kh", "ph": "f", "z": "j", "sh": "s", "y": "i"}


def fold_roman(c: Column) -> Column:
    """Roman up to style: marks, vowel length, w/v, chh/ch, nasal spellings, hyphens and apostrophes."""
    s = F.regexp_replace(nfd(F.lower(c)), r"\p{M}", "")
    s = _replaced(F.regexp_replace(s, "['’‘ʻʿ-]", ""), _LEVEL)
    return _replaced(F.regexp_replace(s, r"([aeiou])\1+", "$1"), _AFTER)


def fold_roman_sql(x: str) -> str:
    s = _replaced_sql(f"regexp_replace(strip_accents(lower({x})), '[''’‘ʻʿ-]', '', 'g')", _LEVEL)
    for v in "aeiou":
        s = f"regexp_replace({s}, '{v}+', '{v}', 'g')"
    return _replaced_sql(s, _AFTER)


def degeminated(c: Column) -> Column:
    return F.regexp_replace(c, r"([^aeiou])\1+", "$1")


def loose_roman(c: Column) -> Column:
    """Roman up to vowel length."""
    return F.regexp_replace(_replaced(F.lower(c), {"w": "v", "ee": "i", "oo": "u"}), r"([aeiou])\1+", "$1")


def loosest_roman(c: Column) -> Column:
    """Roman up to everything but the vowels between consonants."""
    return F.regexp_replace(_replaced(fold_roman(c), _LOOSE), r"(.)\1+", "$1")


def alignment_fold(c: Column) -> Column:
    """Roman or Devanagari up to marks, punctuation and doubling."""
    s = F.regexp_replace(nfd(F.lower(c)), r"\p{Mn}|[़्ंँः'’.-]", "")
    return F.regexp_replace(_replaced(s, {"w": "v", "ee": "i", "oo": "u"}), r"(.)\1+", "$1")


# --- Devanagari -----------------------------------------------------------------------------------
def nasal_sign(c: Column, halves: str, before: str = _CONSONANT) -> Column:
    """Half nasals before a consonant as the nasal sign."""
    return F.regexp_replace(c, f"[{halves}]{C.VIRAMA}(?={before})", C.ANUSVARA)


def _nasal_sign_sql(x: str, halves: str) -> str:
    for _ in range(2):  # a match takes the consonant with it, which may begin the next
        x = f"regexp_replace({x}, '[{halves}]{C.VIRAMA}({_CONSONANT})', '{C.ANUSVARA}\\1', 'g')"
    return x


def fold_hindi(c: Column) -> Column:
    """Devanagari up to nuktas, the way nasals are written and viramas."""
    s = F.translate(nfc(c), f"{C.CANDRABINDU}{C.NUKTA}{C.ZWJ}{C.ZWNJ}", C.ANUSVARA)
    return F.replace(nasal_sign(s, "ङञणनम"), F.lit(C.VIRAMA), F.lit(""))


def fold_hindi_sql(x: str) -> str:
    s = f"translate(nfc_normalize({x}), '{C.CANDRABINDU}{C.NUKTA}{C.ZWJ}{C.ZWNJ}', '{C.ANUSVARA}')"
    return f"replace({_nasal_sign_sql(s, 'ङञणनम')}, '{C.VIRAMA}', '')"


def fold_deva(c: Column, izafat: bool = True) -> Column:
    """Devanagari up to the ain mark, hyphens, blanks, nuktas and nasals; without ``izafat`` up to that too."""
    s = F.replace(c, F.lit("’"), F.lit("'"))
    if not izafat:
        s = F.regexp_replace(s, r"-ए-|-ए$|-ए\s", "-")
    s = F.regexp_replace(nfd(s), f"[\\s'{C.NUKTA}-]", "")
    s = nasal_sign(F.replace(s, F.lit(C.CANDRABINDU), F.lit(C.ANUSVARA)), "ङञणनम")
    return nfc(F.regexp_replace(s, f"(^|{C.VIRAMA})यों", "$1यूं"))


def fold_conventions(c: Column) -> Column:
    """Devanagari up to conventions: ain mark, nukta, nasal sign."""
    return nasal_sign(F.translate(nfd(c), f"{C.CANDRABINDU}'{C.NUKTA}", C.ANUSVARA), "नम")


def fold_gold(c: Column) -> Column:
    """Devanagari as accuracy counts it: nuktas, nasals and joiners set aside, no danda at the edges."""
    s = F.translate(nfc(c), f"{C.CANDRABINDU}{C.NUKTA}{C.ZWJ}{C.ZWNJ}", C.ANUSVARA)
    return F.regexp_replace(nasal_sign(s, "ङञणनम"), "^[ ।.]+|[ ।.]+$", "")


def fold_gold_sql(x: str) -> str:
    s = f"translate(nfc_normalize({x}), '{C.CANDRABINDU}{C.NUKTA}{C.ZWJ}{C.ZWNJ}', '{C.ANUSVARA}')"
    return f"regexp_replace({_nasal_sign_sql(s, 'ङञणनम')}, '^[ ।.]+|[ ।.]+$', '', 'g')"


def fold_nasals(c: Column) -> Column:
    return nasal_sign(F.replace(c, F.lit(C.CANDRABINDU), F.lit(C.ANUSVARA)), "नम")


#: Each half nasal and the consonants of its own class.
_CLASSES = {"ङ": "क-घ", "ञ": "च-झ", "ण": "ट-ढ", "न": "क-धसशष", "म": "प-भ"}


def homorganic_nasals(c: Column) -> Column:
    """Half nasals before a consonant of their own class as the nasal sign."""
    for nasal, own in _CLASSES.items():
        c = nasal_sign(c, nasal, f"[{own}]")
    return c


def line_nasals(c: Column) -> Column:
    """As the line engine writes them: never before a labial."""
    return nfc(nasal_sign(nfd(c), "ङञणन", "[कखगघचछजझटठडढतथदध]"))


# --- Urdu sounds ----------------------------------------------------------------------------------
#: Urdu letters that sound alike; marks and silent letters are dropped.
SAME_SOUND = {
    "ط": "ت", "ث": "س", "ص": "س", "ح": "ہ", "ذ": "ز", "ض": "ز", "ظ": "ز", "ژ": "ز", "ق": "ک", "غ": "گ", "خ": "ک", "ۂ": "ہ", "ۃ": "ہ",
    "ة": "ہ", "ئ": "ی", "ۓ": "ی", "ے": "ی", "ؤ": "و", "آ": "ا", "أ": "ا", "ں": "ن", "ع": "", "ء": "", "ھ": "", C.HAMZA_ABOVE: "", C.KHARI_ZABAR: "", C.ZER: "",
}


def sound(c: Column) -> Column:
    """Urdu by sound: homophone letters one, a silent he at the end as alif."""
    s = F.regexp_replace(F.replace(c, F.lit("ی" + C.KHARI_ZABAR), F.lit("ا")), "ہ$", "ا")
    return F.translate(s, *C.pair(SAME_SOUND))


def sound_skeleton(c: Column) -> Column:
    return F.translate(sound(c), "اوی", "")
