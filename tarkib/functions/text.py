"""Splitting, cleaning and testing text with native column expressions.

NULL gives NULL (predicates: NULL, which filters drop), '' gives '' or an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import chars as C

PUNCT = "".join(C.PUNCT_DEVA)


# --- splitting ------------------------------------------------------------------------------------
def lines(c: Column) -> Column:
    """Lines without blanks at their ends; empty lines dropped. A carriage return is no line."""
    return F.filter(F.transform(F.split(F.replace(c, F.lit("\r"), F.lit("")), "\n"), lambda x: F.regexp_replace(x, f"^[{C.BLANK}]+|[{C.BLANK}]+$", "")), lambda x: x != "")


def stream(c: Column) -> Column:
    """Urdu runs and everything between them, in order; nothing is lost."""
    return F.regexp_extract_all(c, F.lit(f"{C.URDU_RUN}|{C.GAP_RUN}"), F.lit(0))


def urdu_tokens(c: Column) -> Column:
    """The Urdu runs alone, their punctuation peeled off; runs of nothing but punctuation dropped."""
    runs = F.regexp_extract_all(c, F.lit(C.URDU_RUN), F.lit(0))
    return F.filter(F.transform(runs, lambda x: F.regexp_replace(x, f"^[{PUNCT}]+|[{PUNCT}]+$", "")), lambda x: x != "")


def peel(c: Column) -> Column:
    """struct<prefix, core, suffix>: marks at the edges of a token; a token of marks is all prefix."""
    rx = f"^([{PUNCT}]*)(.*?)([{PUNCT}]*)$"
    return F.struct(*[F.regexp_extract(c, rx, i + 1).alias(n) for i, n in enumerate(("prefix", "core", "suffix"))])


def sentences(c: Column) -> Column:
    """Texts between sentence marks and line breaks, trimmed, blanks single; empty ones dropped."""
    parts = F.split(c, "[\n۔؟!.]+")
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, f"[{C.BLANK}]+", " "))), lambda x: x != "")


def words(c: Column) -> Column:
    """Blank-separated words."""
    return F.filter(F.split(c, f"[{C.BLANK}\n]+"), lambda x: x != "")


def plain_words(c: Column) -> Column:
    """Words for scoring: everything that is no letter, mark, digit or underscore becomes a blank, lower case."""
    return words(F.lower(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}_]", " ")))


def edge_tokens(c: Column, lower: bool = False) -> Column:
    """Words with everything that is no word or Devanagari character stripped from their edges."""
    straight = F.translate(c, "’‘", "''")
    cut = F.transform(words(straight), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}_\x{900}-\x{97F}]+|[^\p{L}\p{N}_\x{900}-\x{97F}]+$", ""))
    out = F.filter(cut, lambda x: x != "")
    return F.transform(out, F.lower) if lower else out


# --- cleaning -------------------------------------------------------------------------------------
def punct(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, *C.pair(table))


def line_punct(c: Column, table: dict[str, str]) -> Column:
    """Punctuation and digits of a gap between runs: also the per cent sign; a lone hamza is dropped."""
    return F.translate(c, *C.pair(table | {"٪": "%", "ء": ""} | C.digits(C.ARABIC_DIGITS, C.URDU_DIGITS)))


#: The entities of the pages read, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def strip_html(c: Column) -> Column:
    """Text of an HTML fragment: tags out, entities in, blanks single."""
    s = F.regexp_replace(c, "<[^>]+>", "")
    for k, v in ENTITIES.items():
        s = F.replace(s, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(s, f"[{C.BLANK}\n]+", " "))


def clean_markup(c: Column) -> Column:
    """A line of wiki markup as plain text: references, templates, link targets, tags and quotes out."""
    s = F.regexp_replace(c, r"<ref[^>]*>.*?</ref>|<ref[^>]*/>", "")
    s = F.regexp_replace(s, r"\{\{[^{}]*\}\}", "")
    s = F.regexp_replace(s, r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    s = F.regexp_replace(s, r"<[^>]+>|'{2,}|&nbsp;", " ")
    s = F.regexp_replace(s, "^[:*#; ]+", "")
    return F.trim(F.regexp_replace(s, f"[{C.BLANK}\n]+", " "))


def placeholders(c: Column, o: str, e: str) -> Column:
    """Joins of a rendered line: U+0001 is the conjunction, U+0002 a written izafat."""
    s = F.regexp_replace(c, " ?\x01 ?", f"-{o}-")
    s = F.regexp_replace(s, "\x02 (?=\\S)", f"-{e}-")
    return F.replace(s, F.lit("\x02"), F.lit(f"-{e}"))


def quote_pen_name(word: Column, where: Column) -> Column:
    """A pen name in quotes: ``where`` is all, first or last part of a hyphenated word; NULL or '' none."""
    first = F.regexp_replace(word, "^([^-]*)-(.*)$", "'$1'-$2")
    last = F.regexp_replace(word, "^(.*)-([^-]*)$", "$1-'$2'")
    whole = F.concat(F.lit("'"), word, F.lit("'"))
    hyphen = word.contains("-")
    return F.when((F.coalesce(where, F.lit("")) == "") | (word == ""), word).when((where == "last") & hyphen, last).when((where == "first") & hyphen, first).otherwise(whole)


def fenced_json(c: Column) -> Column:
    """The JSON of a model's answer: its code fence off; if it doesn't begin with a brace then, from the first
    brace to the last. NULL where there is none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), "^```(?i:json)?\\s*", ""), "\\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(bare.startswith("{") & bare.endswith("}"), bare).when(inner != "", inner)


# --- tests ----------------------------------------------------------------------------------------
def has_urdu(c: Column) -> Column:
    return c.rlike(r"[\x{600}-\x{6FF}]")


def urdu_share(c: Column) -> Column:
    """Share of Urdu letters among all letters; NULL for a text without letters."""
    all_ = F.regexp_count(c, F.lit(r"\p{L}"))
    urdu = F.regexp_count(c, F.lit(r"[\x{600}-\x{6FF}&&\p{L}]"))
    return F.when(all_ > 0, urdu / all_)


def is_urdu_word(c: Column) -> Column:
    return c.rlike(f"^[{C.URDU_LETTERS}{C.HARAKAT}{C.KHARI_ZABAR}{C.HAMZA_ABOVE}]+$")


def is_casual_roman(c: Column) -> Column:
    return c.rlike("^[a-z]+$")


def is_devanagari(c: Column) -> Column:
    return c.rlike(r"^[\x{900}-\x{97F}]+$")


def word_count_between(c: Column, least: int, most: int) -> Column:
    return F.size(words(c)).between(least, most)


def is_arabic(c: Column, most: int = 2) -> Column:
    """More letters than ``most`` that only Arabic writes."""
    return F.regexp_count(c, F.lit("[ةىيك]")) > most


def is_title_word(c: Column) -> Column:
    """One token of two characters or more."""
    return c.rlike(f"^[^{C.BLANK}\n_]{{2,}}$")


#: The single letters that are words.
SINGLE_WORDS = ("ء", "و", "ع", "آ")


def is_dictionary_word(c: Column) -> Column:
    """A run with at least two real letters and no comma, or one of the single letters that are words."""
    return (c.rlike(f"^{C.URDU_RUN}$") & (F.regexp_count(c, F.lit(f"[{C.URDU_LETTERS}]")) >= 2) & ~c.contains("،")) | c.isin(*SINGLE_WORDS)


def leaks(c: Column) -> Column:
    """An output that still holds a Perso-Arabic character."""
    return c.rlike(r"[\x{600}-\x{6FF}]")


def has_alternatives(c: Column) -> Column:
    """A reading with signs of alternatives, notes or digits: no single clean reading."""
    return c.rlike(r"""[,~/()0-9;:\[\]{}<>=+*&%$#@|\\"]""")


#: Endings of Urdu words, of which one is taken off.
SUFFIXES = ("نا", "ا", "ہ", "ی", "ے", "ں")


def stem(c: Column) -> Column:
    """The word without one ending if two letters or more remain."""
    return F.regexp_replace(c, f"^(.{{2,}}?)(?:{'|'.join(SUFFIXES)})$", "$1")
