import random
from collections import Counter, defaultdict

from tarkib.llm import graphs, splits


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1300)] + [(2000, 2000 + k) for k in range(1, 500)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, graphs.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: root(x) for x in parent}
    assert graphs.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_differencing_with_equal_sizes():
    sizes = [(1, 10_007), (3, 401), (50, 7), (900, 1)]
    counts = splits.binned(sizes, 20)
    assert counts.sum(axis=1).tolist() == [c for _, c in sizes]
    sums = sorted(sum(n * counts[k, b] for k, (n, _) in enumerate(sizes)) for b in range(20))
    rest = [s for s in sums if s < 900]
    assert max(rest) - min(rest) <= 60 and splits.binned([], 4).shape == (0, 4)


def rows_of(n, seed):
    r = random.Random(seed)
    names = [f"عنوان {k}" for k in range(40)]
    out = []
    for k in range(n):
        grp = "عنوان  بڑا!" if r.random() < 0.3 else r.choice(names) if r.random() < 0.6 else r.choice(["", None, "--"])
        out.append((k, f"i{r.randrange(n * 3)}" if k % 5 else None, r.choice(["poem", " Poem", "wiki"]), grp.replace(" ", "  ") if grp and r.random() < 0.3 else grp))
    return out


def test_related_rows_stay_together_in_about_the_wanted_shares(spark):
    rows = rows_of(3000, 1)
    df = spark.createDataFrame([*rows, rows[0]], "label_id long, id string, src string, grp string")
    out = splits.assign(splits.with_component(df, "src", "grp", ["id"], ["label_id"]), {"train": 0.8, "validation": 0.1, "test": 0.1}, 50, 8).collect()
    assert len(out) == 3001
    together = defaultdict(set)
    for x in out:
        key = "".join(c for c in x.grp or "" if c.isalnum())
        if key:
            together["g", x.src.strip().lower(), key].add(x.split)
        if x.id is not None:
            together["i", x.id].add(x.split)
        together["c", x.component].add(x.split)
    assert all(len(v) == 1 for v in together.values())
    share = Counter(x.split for x in out)
    assert abs(share["train"] / 3001 - 0.8) < 0.03 and abs(share["test"] / 3001 - 0.1) < 0.03
    again = splits.assign(splits.with_component(df.repartition(7), "src", "grp", ["id"], ["label_id"]), {"train": 0.8, "validation": 0.1, "test": 0.1}, 50, 8).collect()
    assert {(x.label_id, x.split) for x in again} == {(x.label_id, x.split) for x in out}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (None, None, "", " "), (2, "a", "poem", "x" * 50_000)], "label_id long, id string, src string, grp string").selectExpr("*", "1 AS component_", "2 AS key", "3 AS n", "4 AS u")
    out = splits.assign(splits.with_component(df, "src", "grp", ["id"], ["label_id"]), {"a": 1.0, "b": 1.0})
    assert out.count() == 4 and {"key", "n", "u", "split", "component"} <= set(out.columns)
    none = df.where("false")
    assert splits.assign(splits.with_component(none, "src", "grp", ["id"], ["label_id"]), {"a": 1.0}).count() == 0
    assert splits.same_group_names(none).count() == 0


def test_names_of_one_group(spark):
    rows = [("poem", "شہر کا"), ("Poem ", "شہرِ کا"), ("poem", "شھر کا"), ("wiki", "شہر کا"), ("poem", "باب ۲"), ("poem", "باب 2"), ("poem", None), ("poem", ""), ("poem", "!!")]
    got = {tuple(x) for x in splits.same_group_names(spark.createDataFrame(rows, "src string, grp string")).collect()}
    assert got == {("poem", *sorted(("شہر کا", "شہرِ کا"))), ("poem", *sorted(("باب ۲", "باب 2")))}
