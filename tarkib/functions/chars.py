"""Character facts that the text functions share, and helpers that turn them into Spark and SQL expressions."""

from __future__ import annotations

# --- Fixed values: Unicode and Urdu letter facts -----------------------------------------------
TATWEEL, ZWNJ, ZWJ, LRM, RLM = "ـ", "‌", "‍", "‎", "‏"
ZER, SHADDA, SUKUN, KHARI_ZABAR, HAMZA_ABOVE, TAKHALLUS = "ِ", "ّ", "ْ", "ٰ", "ٔ", "ؔ"
NUKTA, VIRAMA, ANUSVARA, CANDRABINDU, VISARGA = "़", "्", "ं", "ँ", "ः"
#: Vowel and reading marks that the scheme normaliser drops.
HARAKAT = "".join(map(chr, [*range(0x064B, 0x0653), 0x0653, *range(0x0655, 0x0660)]))
HONORIFICS = "ؐ-ؚ"
URDU_LETTERS = "ءآأؤإئابپتٹثجچحخدڈذرڑزژسشصضطظعغفقکگلمنںوہۂھیےۓ"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
URDU_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "0123456789"
#: Letter folds of each normaliser; a letter that maps to '' is dropped.
RULE_FOLDS = {"ي": "ی", "ك": "ک", "أ": "ا", "إ": "ا", "ؤ": "و", "ئ": "ی", "ء": "", "ة": "ہ", "ۃ": "ت", TATWEEL: ""}
SCHEME_FOLDS = {
    "ي": "ی", "ى": "ی", "ك": "ک", "ه": "ہ", "ە": "ہ", "ة": "ہ", "أ": "ا", "إ": "ا", "ٱ": "ا", "ۀ": "ۂ", "ٴ": HAMZA_ABOVE,
    TATWEEL: "", ZWNJ: "", ZWJ: "", LRM: "", RLM: "",
}
OCR_FOLDS = {"ي": "ی", "ك": "ک", "ى": "ی", TATWEEL: "", ZWJ: ""}
#: Punctuation of Urdu in Devanagari and in Roman text.
PUNCT_DEVA = {"۔": "।", "؟": "?", "،": ",", "؛": ";"}
PUNCT_ROMAN = {"۔": ".", "؟": "?", "،": ",", "؛": ";"}
#: Marks before which OCR text has no blank.
NO_BLANK_BEFORE = "،۔؟!؛:٫٬,.;?"
SENTENCE_ENDS = "۔؟!?.\n"

#: Every character that Unicode calls white space, but for the line feed.
BLANK = r"\t\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
URDU_RUN = r"[\x{600}-\x{6FF}\x{750}-\x{77F}]+"
GAP_RUN = r"[^\x{600}-\x{6FF}\x{750}-\x{77F}]+"


def digits(*alphabets: str) -> dict[str, str]:
    return {d: str(i) for a in alphabets for i, d in enumerate(a)}


def pair(folds: dict[str, str]) -> tuple[str, str]:
    """The two arguments of ``translate``: letters that are dropped stand last."""
    kept = {k: v for k, v in folds.items() if v}
    gone = [k for k, v in folds.items() if not v]
    return "".join([*kept, *gone]), "".join(kept.values())


#: Ranges of the scripts met most whose characters never change in composition (NFC). Anything else, marks above all,
#: may, and is looked at; the ranges only save work. A test holds them against Unicode.
STABLE = [
    (0x0000, 0x02FF), (0x0370, 0x0373), (0x0388, 0x0482), (0x060C, 0x060F), (0x061B, 0x064A), (0x0660, 0x066F), (0x0671, 0x06D5), (0x06EE, 0x06FF), (0x0750, 0x077F),
    (0x0904, 0x093B), (0x093D, 0x094C), (0x0960, 0x097F), (0x200B, 0x2060), (0x3001, 0x3029), (0x4E00, 0x9FFF), (0xFE70, 0xFEFF), (0x1F300, 0x1FAFF),
]
#: A character outside of these.
MAY_COMPOSE = "[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in STABLE) + "]"
