from tarkib.llm import mixing

TARGETS = [("wiki", 0.5, 1), ("poem", 0.3, 2), ("ocr", 0.2, 3), ("none", 0.1, 1), (None, 0.1, 1), ("wiki", 0.1, 1)]


def frames(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_caps_and_shortfall(spark):
    docs = [(k, "word " * 50, "Wi ki" if k % 10 < 6 else "poem" if k % 10 < 9 else "x") for k in range(3000)] + [(9000 + k, "word " * 20, "OCR") for k in range(5)] + [(9100, None, "wiki"), (9101, "", "poem"), (0, "word " * 50, "wiki")]
    d, t = frames(spark, docs)
    rows = mixing.mix(d, t).collect()
    uses = {}
    for r in rows:
        uses[r.doc_id] = max(uses.get(r.doc_id, 0), r.copy)
    assert max(uses.values()) <= 3 and all(uses[9000 + k] == 3 for k in range(5))
    got = {r.source: r for r in mixing.shares(d, t).collect()}
    total = sum(r.tokens for r in rows)
    assert abs(sum(r.share for r in got.values()) - 1) < 1e-9 and sum(r.tokens for r in got.values()) == total
    assert got["ocr"].rate == 3 and got["ocr"].shortfall > 0.9 * got["ocr"].wanted
    assert abs(got["wiki"].tokens - got["wiki"].wanted) < 0.05 * got["wiki"].wanted and got["poem"].tokens <= 2 * got["poem"].available
    assert got["none"].rate == 0 and got["none"].tokens == 0
    assert {(r.doc_id, r.copy) for r in mixing.mix(d.repartition(5), t).collect()} == {(r.doc_id, r.copy) for r in rows}


def test_a_wanted_size_whose_shares_all_hold(spark):
    d, t = frames(spark, [(k, "word " * 50, ["wiki", "poem", "ocr"][k % 3]) for k in range(3000)])
    got = {r.source: r for r in mixing.shares(d, t, total=60_000).collect()}
    assert all(abs(got[s].share - w) < 0.03 for s, w in (("wiki", 0.5), ("poem", 0.3), ("ocr", 0.2)))


def test_empty(spark):
    d, t = frames(spark, [(1, "a", "wiki")])
    assert mixing.mix(d.where("false"), t).count() == 0 and mixing.mix(d, t.where("false")).count() == 0
    assert {r.tokens for r in mixing.shares(d.where("false"), t).collect()} == {0}
