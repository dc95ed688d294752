"""Goldens of the reading rules and brute force for the measures."""

import random
import re
import sys
import unicodedata

import numpy as np
import pytest

from tarkib.functions import candidates, chars, letters, lining, meter, metrics, roman, runs
from tarkib.operators import ensemble, layout, sequences


@pytest.mark.parametrize("rich,plain,marked", [("kyā", "kya", "kyā"), ("hā~", "haan", "hāñ"), ("kahā~", "kahan", "kahāñ"), ("kahnā", "kehna", "kahnā"), ("kuch", "kuchh", "kuchh"), ("gae", "gaye", "gae"), ("jāe~", "jaayein", "jāeñ")])
def test_renders(rich, plain, marked):
    assert (roman.to_plain(rich), roman.to_marked(rich)) == (plain, marked)


@pytest.mark.parametrize("rich,printed", [("yād", "yaad"), ("kā", "kā"), ("jāne", "jaane"), ("sīne", "siine"), ("jāe", "jaa.e"), ("ārzū", "aarzū"), ("āxir", "āḳhir"), ("zamāne", "zamāne"), ("hāl-e-dil", "hāl-e-dil"), ("kahie lie", "kahiye liye"), ("huā koī gaī", "huā koī ga.ī")])
def test_printed(rich, printed):
    assert roman.to_printed(rich) == printed


def test_back_and_forth():
    for ascii_, rich in (("pa.Dhaa.ii", "paṛhāī"), ("KHauf-e-rasan", "xauf-e-rasan"), ("zhaalaa", "žālā")):
        assert roman.from_typed(ascii_) == rich and roman.to_ascii(rich) == ascii_
    assert roman.from_typed("paḍhā.ī", "पढ़ाई") == "paṛhāī" and roman.from_printed("uthtā", "उठता") == "uṭhtā"
    assert roman.respell_ain("معلوم", "मालूम", "mālūm") == ("मा'लूम", "maalūm") and roman.respell_ain("کتاب", "किताब", "kitāb") == ("किताब", "kitāb")
    assert roman.simple_line("dil-e-nādāñ tujhe huā kyā hai") == "dil-e-nadan tujhe hua kya hai"
    assert [roman.with_future(v, "گے", 1) for v in ("dein", "jaayein", "hoon")] == ["denge", "jaayenge", "honge"]
    assert roman.article("الرحمان", ("रहमान", "rahman", "rahmān"), True) == ("उर-रहमान", "ur-rahman", "ur-rahmān")
    assert roman.page_roman("kitāb̃x") == "kitaabkh" and roman.roman_to_deva("kitaab") == "किताब"
    assert roman.retroflex_r("لڑا", "lada") == "lara" and roman.silent_he("سبزہ", "sabzā") == "sabza"


@pytest.mark.parametrize("deva,urdu", [("है", "ہے"), ("हैं", "ہیں"), ("गए", "گئے"), ("अच्छा", "اچھا"), ("ज्ञान", "گیان"), ("औरत", "عورت"), ("ज़्यादा", "زیادہ"), ("इल्म", "علم")])
def test_spellings(deva, urdu):
    assert urdu in candidates.urdu_spellings(deva) and len(candidates.urdu_spellings(deva)) <= 96


@pytest.mark.parametrize("deva,rich", [("करती", "kartī"), ("हिचकता", "hicaktā"), ("लहंगे", "lahaṅge"), ("फाँसी", "phā~sī"), ("तरूँगी", "tarūṅgī"), ("दुःख", "duhkh")])
def test_schwas(deva, rich):
    assert candidates.rich_readings(deva)[0] == rich


@pytest.mark.parametrize("deva,urdu,rich", [("आँख", "آنکھ", "ā~kh"), ("ए'लान", "اعلان", "e'lān"), ("अफ़्साना", "افسانہ", "afsāna"), ("जल्वा", "جلوۂ", "jalva")])
def test_chosen_readings(deva, urdu, rich):
    assert candidates.chosen_reading(deva, urdu) == rich


def test_evidence_picks_the_schwa():
    assert candidates.chosen_reading("वसवसे", "وسوسے") == "vasavse" and candidates.chosen_reading("वसवसे", "وسوسے", None, {"waswase": 3.0}) == "vasvase"


def test_letters_leave_nothing_urdu():
    for w in ("ذریعہ", "بعد", "شعر", "مکّہ", "ہے۔اور", "حَسَن", "آؤ", "صفحہ"):
        assert not any(re.search("[؀-ۿ]", x.replace("٪", "")) for x in letters.read_word(w, True)), w
    assert letters.mark_curated("نہیں", "nahin") == "nahiñ"


ALIGNED = [
    ("طاقت بیداد انتظار نہیں ہے", "taaqat-e-bedaad-e-intizaar nahin hai", [("taaqat", "-e-"), ("bedaad", "-e-"), ("intizaar", " "), ("nahin", " "), ("hai", " ")]),
    ("نیپال اس کا پڑوسی ملک", "Nepal iska padosi mulk", [("Nepal", " "), ("iska", "+"), (None, " "), ("padosi", " "), ("mulk", " ")]),
    ("نکھر کرسامنے آیا", "nikhar kar saamne aaya", [("nikhar", " "), ("kar saamne", " "), ("aaya", " ")]),
    ("سنہ 1828 ء میں", "sanah 1828 mein", [("sanah", " "), (None, " "), ("mein", " ")]),
    ("سنگ و خشت", "sang o", None),
]


@pytest.mark.parametrize("urdu,line,want", ALIGNED)
def test_alignment(urdu, line, want):
    assert lining.align_output([runs.scheme_key(t) for t in re.findall("[؀-ۿ]+", urdu)], line) == want


def test_units_runs_and_lines():
    assert lining.deva_units("ख़ौफ़-ए-रसन ले") == [["ख़ौफ़", "-e-"], ["रसन", " "], ["ले", " "]]
    assert lining.line_up("پاؤں گا".split(), lining.deva_units("पाऊँगा")) == [(0, 2, 0, 1)]
    assert lining.line_up(["سربسر"], lining.deva_units("सर-बसर")) == [(0, 1, 0, 2)]
    assert runs.segments("وہ 1947ء میں آئے۔") == [("u", "وہ"), ("x", " 1947ء "), ("u", "میں آئے"), ("x", "۔")]
    assert "".join(t for _, t in runs.segments("الف بے " * 30)).split() == ("الف بے " * 30).split() and runs.pen_names("غالبؔ نے") == [True, False]
    assert lining.assign_lines(["helo wrld", "gud bye"], ["good bye", "hello world"], 2) == ["hello world", "good bye"]
    assert layout.line_text(["یہ", "GPT", "OpenAI", "ہے", "a"]) == "یہ OpenAI GPT ہے a"
    assert [len(c) for c in sequences.stanza_chunks(["x"] * 15 + [""] + ["y"] * 20)] == [15, 20]


def test_meter():
    lines = ["dil-e-nādā~ tujhe huā kyā hai", "āxir is dard kī davā kyā hai", "ham hai~ muśtāq aur vo be-zār", "yā ilāhī ye mājrā kyā hai", "mai~ bhī mu~h me~ zabān rakhtā hū~", "kāś pūcho ki muddaā kyā hai", "phir ye haṅgāma ai xudā kyā hai", "abr kyā cīz hai havā kyā hai"]
    w = [meter.syllables(x) for x in lines]
    bad = "phir ye haṅgāma-e-ai xudā kyā hai"
    assert meter.support(w, w[6], 6) > meter.support(w, meter.syllables(bad), 6) + 3
    for a in w:
        for b in w:
            assert meter.compatible(a, b) == bool(set(meter.readings(a)) & set(meter.readings(b)))
    poem = [(x, bad if i == 6 else x, -0.1, [("right", lines[6], -0.1)] if i == 6 else []) for i, x in enumerate(lines)]
    assert ensemble.reread(poem) == [*lines[:6], "right", lines[7]]
    assert "संग-ए-दिल" in ensemble.izafat_toggles("سنگ دل", "संग दिल") and meter.readings(["-u"] * 13) == []


def test_lines_fitted_all_at_once():
    r = random.Random(5)
    for t in range(60):
        def line(r=r, t=t):
            return "".join(r.choice("-uoxx" if t % 2 else "-uuo-ox") for _ in range(r.choice([0, 1, 3, 6, 7, 63, 64, 65, 130]) if t % 10 == 0 else r.randrange(0, 9)))

        a, b = [line() for _ in range(r.randrange(0, 25))], [line() for _ in range(r.randrange(0, 25))]
        n = np.array([r.randrange(1, 5) for _ in b], dtype=np.int64)
        x, y = ([["-u" if c == "o" else c for c in s] for s in side] for side in (a, b))
        assert meter.fitting(a, b, n).tolist() == [sum(int(m) for w, m in zip(y, n, strict=True) if meter.compatible(v, w)) for v in x]


def test_meter_support_of_a_long_poem(spark, monkeypatch):
    """2,500 lines of one poem, which were 6 million pairs in Python before, in one block and in several."""
    r = random.Random(6)
    words = ["dil", "nādā~", "tujhe", "huā", "kyā", "hai", "dard", "kī", "davā", "ham", "muśtāq", "aur", "vo", "be-zār", "ye", "mājrā", "zabān", "haṅgāma", "xudā", "abr", "cīz"]
    rows = [("a", i, " ".join(r.choice(words) for _ in range(r.randrange(3, 8)))) for i in range(2500)]
    rows += [("b", 3000 + i, x) for i, x in enumerate([rows[0][2], rows[0][2], rows[1][2], "", None])] + [(None, 4000, rows[0][2])]
    df = spark.createDataFrame(rows, "poem string, line long, rich string")
    found = ensemble.meter_support(df, ["poem"], "line", "rich")
    assert "share_a_meter" not in found._jdf.queryExecution().analyzed().toString()
    got = {x.line: (x.poem, x.support, x.others) for x in found.collect()}
    assert found.dtypes == [("poem", "string"), ("line", "bigint"), ("support", "bigint"), ("others", "bigint")]
    scanned = {i: (p, meter.syllables(x)) for p, i, x in rows if p and x}
    assert got.keys() == scanned.keys()
    for i in [*range(12), *range(3000, 3003)]:
        poem, w = scanned[i]
        others = [v for j, (p, v) in scanned.items() if p == poem and j != i]
        assert got[i] == (poem, sum(meter.compatible(w, v) for v in others), len(others))
    monkeypatch.setattr(ensemble, "COMPARED", 700)
    monkeypatch.setattr(ensemble, "AMONG", 900)
    assert {x.line: (x.poem, x.support, x.others) for x in ensemble.meter_support(df, ["poem"], "line", "rich").collect()} == got


def test_measures_against_brute_force():
    r = random.Random(1)
    for _ in range(400):
        a, b = ("".join(r.choices("abc", k=r.randrange(0, 40))) for _ in range(2))
        row, lcs = list(range(len(b) + 1)), [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            last, row[0], before = row[0], i, lcs[:]
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
                lcs[j] = before[j - 1] + 1 if x == y else max(before[j], lcs[j - 1])
        assert metrics.distance(a, b) == row[-1] and metrics.lcs(a, b) == lcs[-1]


def test_stable_ranges_hold_against_unicode():
    stable = {c for a, b in chars.STABLE for c in range(a, b + 1)}
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        if cp in stable:
            assert unicodedata.normalize("NFC", ch) == ch and not unicodedata.combining(ch)
        d = unicodedata.decomposition(ch)
        if d and "<" not in d and " " in d:
            assert int(d.split()[1], 16) not in stable
