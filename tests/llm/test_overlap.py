import random

from tarkib.llm import overlap
from tarkib.llm.common import letters, words

WORDS = "کتاب شہر دریا پھول رات دن سمندر جنگل پرانا نیا گہرا آسمان زمین بچہ گھر بازار راستہ سڑک پانی ہوا روشنی خوشی دیوار دروازہ چاند سورج".split()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def same(a, b):
    if not letters(a) or not letters(b):
        return False
    if letters(a) == letters(b):
        return True
    x, y = letters(a), letters(b)
    return min(len(words(a)), len(words(b))) >= 6 and distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9)


def edited(text, r):
    for _ in range(r.randrange(0, 9) if len(text) > 9 else 0):
        i = r.randrange(len(text))
        text = text[:i] + r.choice(["", r.choice("ابتکلمن "), text[i] + r.choice("ابت")]) + text[i + r.randrange(0, 2) :]
    return text


def test_against_brute_force(spark):
    r = random.Random(11)
    left = [" ".join(r.choice(WORDS) for _ in range(r.choice([1, 2, 5, 6, 7, 9, 14]))) for _ in range(60)]
    right = [edited(r.choice(left), r) for _ in range(150)] + [" ".join(r.choice(WORDS) for _ in range(r.randrange(5, 12))) for _ in range(60)] + ["کِتاب،", "كتاب", "", None, "!!"]
    a = spark.createDataFrame([*enumerate([*left, "کتاب", "", None, "ا" * 3000]), (0, left[0])], "test_id long, urdu string").selectExpr("*", "1 AS h", "2 AS key", "'x' AS g")
    b = spark.createDataFrame([*enumerate(right), (3, right[3])], "train_id long, src string").selectExpr("*", "1 AS h", "2 AS key")
    got = {(x.a, x.b) for x in overlap.overlaps(a, b, "test_id", "urdu", "train_id", "src").collect()}
    lefts = dict(enumerate([*left, "کتاب", "", None, "ا" * 3000]))
    want = {(i, j) for i, x in lefts.items() for j, y in enumerate(right) if same(x, y)}
    assert got == want and len(want) > 50
    none = a.where("false")
    assert overlap.overlaps(none, b, "test_id", "urdu", "train_id", "src").count() == 0
    assert overlap.overlaps(a, b.where("false"), "test_id", "urdu", "train_id", "src").count() == 0


def test_nothing_is_broadcast_by_a_guessed_size(spark, tmp_path):
    """The index holds hundreds of rows for each text, of which Spark's size of it knows nothing."""
    r = random.Random(3)
    texts = [" ".join(r.choice(WORDS) for _ in range(9)) for _ in range(40)]
    spark.createDataFrame([*enumerate(texts)], "test_id long, urdu string").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([*enumerate(edited(x, r) for x in texts)], "train_id long, src string").write.parquet(f"{tmp_path}/b")
    a, b = spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b")
    found = overlap.overlaps(a, b, "test_id", "urdu", "train_id", "src")
    assert found.count() >= 10 and "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()


def test_sketches_never_part_near_keys():
    r = random.Random(2)
    for _ in range(3000):
        a = "".join(r.choice("اایییہرنوکےمتلسھبپ٣xyz") for _ in range(r.randrange(3, 80)))
        b = edited(a, r).replace(" ", "")
        k = distance(a, b)
        (p, q), (s, t) = overlap.sketch(a), overlap.sketch(b)
        mask = (1 << 64) - 1
        more = sum(((x & mask) & ~(y & mask)).bit_count() for x, y in ((p, s), (q, t)))
        less = sum(((y & mask) & ~(x & mask)).bit_count() for x, y in ((p, s), (q, t)))
        assert more <= k and less <= k
