import random

from tarkib.llm import defects

LINES = ["باغ میں پھول کھلتے ہیں", "دریا کے کنارے شہر ہے", "رات بہت سرد تھی", "وہ کتاب پڑھتا ہے", "سمندر نیلا اور گہرا", "بچہ دوڑتا ہوا گیا"]
WRONG = "सबज़ जंगल पुराना रासता दूर तक"


def verdicts(spark, answers):
    rows = [(n, ur, hi, None) for n, (ur, hi) in enumerate(zip(LINES, answers, strict=True))] + [(99, "سبز جنگل پرانا راستہ دور تک", WRONG, "سبز جنگل پرانا راستہ دور تک")]
    labels = spark.createDataFrame(rows, "label_id long, ur string, hi string, back string")
    return {r.label_id: r.defect for r in defects.defects(labels).collect()}


def test_a_wrong_reading_given_often_is_no_refusal(spark):
    assert verdicts(spark, [WRONG] * 6) == dict.fromkeys(range(6), "unrelated")


def test_templates_and_rarer_wordings_of_the_same_words(spark):
    said = ["Please send a different text to me instead"] * 4 + ["A different text instead, please send me"] + ["The copyist dropped every sign while nobody looked"]
    assert verdicts(spark, said) == dict.fromkeys(range(5), "refusal") | {5: "language"}


def test_each_kind(spark):
    ur = "وہ کتاب پڑھتا ہے اور شہر دیکھتا ہے"
    good = "वो किताब पढ़ता है और शहर देखता है"
    cases = {
        1: (ur, good, ur, None), 2: (ur, None, None, "empty"), 3: (ur, " !", None, "empty"), 4: (ur, "वो किताब पढ़", None, "truncated"), 5: (ur, ur, None, "copy"),
        6: (ur, good + " है और शहर देखता है और शहर देखता है और शहर देखता है और शहर देखता", None, "loop"), 7: (ur, "नीला समुंदर गहरा जंगल मकान", None, "unrelated"),
        8: (ur, "vo kitaab padhta hai aur shahr dekhta hai", None, "language"), 9: (ur, good, good, "copy"), 10: (ur, good, "", "empty"), 11: (ur, good, None, "empty"),
        12: (None, "किताब", "کتاب", "unrelated"),
    }
    rows = [(k, a, b, c) for k, (a, b, c, _) in cases.items()]
    df = spark.createDataFrame([*rows, rows[3], (None, ur, None, None)], "label_id long, ur string, hi string, back string").selectExpr("*", "1 AS opening", "'x' AS cluster", "2 AS words")
    got = {r.label_id: r.defect for r in defects.defects(df).collect()}
    want = {k: d for k, (*_, d) in cases.items() if d}
    assert {k: v for k, v in got.items() if k != 8} == {k: v for k, v in want.items() if k != 8}
    assert defects.defects(df.where("false")).count() == 0


def test_links_lose_no_pair_of_a_band(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(12)]
    texts = sorted({b[:i] + "x" + b[i + 1 :] for b in base for i in r.sample(range(60), 3)} | set(base))
    df = spark.createDataFrame([(t,) for t in texts], "opening string")
    got = {x.opening: x.cluster for x in defects.clusters(df).collect()}
    assert set(got) == set(texts)

    def alike(a, b):
        p, q = (set(defects._shingles(x).tolist()) for x in (a, b))
        return len(p & q) >= 0.8 * len(p | q)

    near = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if alike(a, b)]
    assert near and sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near)
    assert all(any(alike(a, b) for b in texts if b != a and got[b] == got[a]) for a in texts if list(got.values()).count(got[a]) > 1)
