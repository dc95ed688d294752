import random
import re
import unicodedata

from tarkib.llm import text_forms
from tarkib.llm.common import canon

ALPHABET = ["ا", "آ", "ی", "ے", "ک", "ہ", "ئ", "ؤ", "ء", "ٓ", "ٔ", "ك", "ي", "ى", "‌", "‍", "َ", "ّ", " ", "  ", " ", "\n", "\t", "\r\n", "र", "क़", "ऩ", "न", "़", "्", "ि", "é", "é", "①", "ﷺ", "ﻻ", "Ａ", "1", "٤", "٧", "۷", " ", "﻿", "\U0002f800", "\U000e0020", "\U000e0100", "𝐀", "А", "‐"]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randrange(0, 12))) for _ in range(n)]


def test_the_form_is_stable_and_joins_look_alikes():
    for t in texts(20_000, 1):
        c = canon(t)
        assert canon(c) == c, t
        assert canon(unicodedata.normalize("NFD", c)) == c or "ک" in c
        assert not re.search("[​-‏﻿\U000e0020\U000e0100]|  | \n|\n ", c)
    assert canon("a\U0002f800") == canon("a​\U0002f800") == "a丽" and canon("x\U000e0020y") == "xy"
    assert canon("न" + "़") == canon("ऩ") and canon(None) is None and canon("  \n") == ""


def test_spark_agrees_with_the_plain_form(spark):
    ts = [*texts(3000, 2), "ا" * 200_000 + "  ك", None, ""]
    df = spark.createDataFrame(list(enumerate(ts)), "id long, text string")
    got = {r.id: r.canonical for r in text_forms.unify(df, "text").collect()}
    assert got == {k: canon(t) for k, t in enumerate(ts)}


def test_pairs_and_classes(spark):
    r = random.Random(3)
    rows = [(k, r.randrange(6), t) for k, t in enumerate(texts(150, 4) * 2 + ["كتاب", "کتاب", "کتاب ", "کتاب", "", None, " "])]
    df = spark.createDataFrame([*rows, rows[0], (None, 1, "x"), (999, None, "x")], "id long, g long, t string").selectExpr("*", "1 AS k", "2 AS s", "3 AS text")
    got = {tuple(x) for x in text_forms.look_alikes(df, "id", "t", "g").collect()}
    want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[1] == b[1] and a[2] is not None and b[2] is not None and a[2] != b[2] and canon(a[2]) and canon(a[2]) == canon(b[2])}
    assert got == want and want
    classes = {x.id: x for x in text_forms.form_classes(df, "id", "t", "g").collect()}
    assert {i for p in want for i in p} <= set(classes) and all((classes[a].class_id == classes[b].class_id) for a, b in want)
    assert text_forms.look_alikes(df.where("false"), "id", "t").count() == 0
