import random

from tarkib.llm import spans

ALPHABET = "ابپتٹجچحخدڈرزسشعغفقکگلمنوہی "


def noise(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(ALPHABET) for _ in range(n))


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def shares(a, b, span=spans.SPAN):
    return any(a[i : i + span] in b for i in range(len(a) - span + 1))


def covered(a, others, span=spans.SPAN):
    hit = [False] * len(a)
    for i in range(len(a) - span + 1):
        if any(a[i : i + span] in o for o in others):
            hit[i : i + span] = [True] * span
    return sum(hit)


def test_against_brute_force(spark):
    r = random.Random(5)
    parts = [noise(r.choice([60, 119, 120, 121, 200]), 100 + k) for k in range(8)]
    texts = [noise(r.randrange(0, 80), k) + "".join(x for p in r.sample(parts, 3) for x in (p, noise(r.randrange(0, 50), k * 7))) for k in range(30)]
    texts += [texts[0], texts[0], "", "x", noise(5000, 77) + parts[4]]
    df = docs(spark, texts)
    got = {tuple(x) for x in spans.sharing_documents(df).collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if shares(texts[i], texts[j])}
    assert got == want and want
    amounts = {x.doc_id: x for x in spans.shared_amount(df).collect()}
    for i, t in enumerate(texts):
        others = [u for u in texts if u != t]
        whole = texts.count(t) > 1 and len(t) >= spans.SPAN
        assert amounts[i].verbatim_chars == (len(t) if whole else covered(t, others)), i
        assert amounts[i].fuzzy_chars >= amounts[i].verbatim_chars
    links = {x.doc_id: x for x in spans.sharing_classes(df).collect()}
    for i in links:
        kinds = {texts[b if a == i else a] for a, b in want if i in (a, b)} - {texts[i]}
        assert links[i].links == len(kinds) and links[i].copies == texts.count(texts[i]) - 1


def test_a_passage_many_times_in_one_text(spark):
    passage = noise(200, 1)
    long = "".join(passage + noise(37, 10 + k) for k in range(9))
    got = {x.doc_id: x for x in spans.shared_amount(docs(spark, [long, noise(100, 2) + passage])).collect()}
    assert got[0].verbatim_chars == 1800 and got[0].passages == 9 and got[1].verbatim_chars == 200


def test_two_shorter_stretches_are_no_span(spark):
    one, two = noise(112, 3), noise(112, 4)
    texts = [noise(70, 5) + one + "کگ" * 15 + two + noise(60, 6), noise(60, 7) + one + "فق" * 15 + two + noise(90, 8)]
    df = docs(spark, texts)
    assert spans.sharing_documents(df).count() == 0
    assert {x.verbatim_chars for x in spans.shared_amount(df).collect()} == {0}


def test_a_gap_is_fuzzy_only(spark):
    one, two = noise(130, 3), noise(125, 4)
    texts = [noise(70, 5) + one + "کگ" * 15 + two + noise(60, 6), noise(60, 7) + one + "فق" * 15 + two + noise(90, 8)]
    got = {x.doc_id: x for x in spans.shared_amount(docs(spark, texts)).collect()}
    assert all(got[i].verbatim_chars == covered(texts[i], [texts[1 - i]]) and got[i].fuzzy_chars == got[i].verbatim_chars + 30 and got[i].passages == 2 for i in (0, 1))


def test_boilerplate_in_many_texts(spark):
    boiler = noise(150, 9)
    texts = [noise(300, 20 + k) + boiler + noise(100, 60 + k) for k in range(40)]
    df = docs(spark, texts)
    assert spans.sharing_documents(df).count() == 40 * 39 // 2
    assert {x.links for x in spans.sharing_classes(df).collect()} == {39}
    assert [x.verbatim_chars for x in sorted(spans.shared_amount(df).collect())] == [covered(t, texts[:k] + texts[k + 1 :]) for k, t in enumerate(texts)]


def test_odd_rows(spark):
    text = noise(300, 1)
    rows = [(1, text, 5, "x"), (1, text, 5, "x"), (2, text + "ا", 5, None), (None, text, 5, "y"), (3, None, 5, None), (4, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, c int, h string")
    assert [tuple(x) for x in spans.sharing_documents(df).collect()] == [(1, 2)]
    got = {x.doc_id: x for x in spans.shared_amount(df).collect()}
    assert got[3].n_chars is None and got[3].verbatim_chars in (0, None) and got[4].verbatim == 0.0
    none = df.where("false")
    assert spans.sharing_documents(none).count() == spans.shared_amount(none).count() == spans.sharing_classes(none).count() == 0


def fuzzily_covered(a, others, half=spans.SPAN // 2, gap=spans.GAP):
    hit = [False] * len(a)
    for b in others:
        at = {}
        for q in range(len(b) - half + 1):
            at.setdefault(b[q : q + half], []).append(q)
        same = {p: at[a[p : p + half]] for p in range(len(a) - half + 1) if a[p : p + half] in at}
        for p in same:
            for q, p2 in ((q, p2) for q in same[p] for p2 in range(p + half, p + half + gap + 1) if any(0 <= q2 - q - half <= gap for q2 in same.get(p2, ()))):
                for q2 in (x for x in same[p2] if 0 <= x - q - half <= gap):
                    s, e = p, p2
                    while q - p + s - 1 in same.get(s - 1, ()):
                        s -= 1
                    while q2 - p2 + e + 1 in same.get(e + 1, ()):
                        e += 1
                    hit[s : e + half] = [True] * (e + half - s)
    return sum(hit)


def test_fuzzy_passages_of_all_pairs(spark):
    one, two = noise(80, 1), noise(80, 2)
    gaps = ["کگ" * 10, "فق" * 10, "", one[-3:] + two[:4], noise(200, 3), noise(201, 4)]
    texts = [noise(90, 10) + one + noise(90, 11), noise(90, 12) + two + noise(90, 13)]
    texts += [noise(40 + k, 20 + k) + one + g + two + noise(50, 30 + k) for k, g in enumerate(gaps)]
    texts += [noise(30, 40) + "".join(one + noise(9, 41 + k) + two + noise(260, 50 + k) for k in range(3)), two + noise(20, 60) + one]
    got = {x.doc_id: x.fuzzy_chars for x in spans.shared_amount(docs(spark, texts)).collect()}
    want = {k: fuzzily_covered(t, texts[:k] + texts[k + 1 :]) for k, t in enumerate(texts)}
    assert got == want and got[0] == got[1] == 0 and got[2] == 180 and got[8] >= 3 * 169


def test_ruled_lines_are_no_square(spark):
    texts = [noise(90, 10 + k) + "-" * (130 + k) + noise(90, 60 + k) for k in range(40)]
    got = {x.doc_id: x for x in spans.shared_amount(docs(spark, texts)).collect()}
    assert all(got[k].fuzzy_chars == got[k].verbatim_chars == covered(t, texts[:k] + texts[k + 1 :]) for k, t in enumerate(texts))


def test_windows_that_stand_twice(spark):
    # the first window of `core` stands twice in one text, the second twice in another: not the same texts
    core = noise(121, 7)
    for k in (2, 3):  # seeds at which the first text is the least class
        texts = [noise(90, 10 + k) + core + noise(30, 11 + k)]
        texts += [noise(40, n + k) + x + noise(40, n + 1 + k) + x + noise(9, m + k) for n, m, x in ((12, 3, core[:120]), (14, 4, core[1:]))]
        assert {tuple(x) for x in spans.sharing_documents(docs(spark, texts)).collect()} == {(0, 1), (0, 2)}
