import datetime as dt
import random

from tarkib.llm import consensus

T0 = dt.datetime(2026, 1, 1)
SKILL = {"a": 0.95, "b": 0.9, "c": 0.85, "d": 0.7, "e": 0.6}
LETTERS = "कखगघचछजझटठडढणतथदधनपफबभमयरलवशसह"


def answers(spark, n=260):
    r = random.Random(8)
    truth = {k: " ".join("".join(r.choice(LETTERS) for _ in range(3)) for _ in range(2)) for k in range(n)}
    rows, rid = [], 0
    for k, t in truth.items():
        said = {}
        for who, skill in SKILL.items():
            if who in "abc" and r.random() < 0.2:
                continue
            said[who] = " ".join(w if r.random() < skill else w[:-1] + r.choice("कतप") for w in t.split())
        if "e" in said:
            said |= {f"copy{i}": said["e"] for i in range(1)}
        for who, text in said.items():
            rid += 1
            rows.append((rid, k, who, True, "  " + text + " ", text.upper(), T0))
    rows += [(rid + 1, 0, "a", False, "x", "x", T0 - dt.timedelta(days=1)), (rid + 2, None, "a", True, "x", "x", T0), (rid + 3, 9999, "a", True, None, "", None), rows[5]]
    df = spark.createDataFrame(rows, "result_id long, item_id long, provider_id string, ok boolean, devanagari string, roman string, created_at timestamp").selectExpr("*", "1 AS alpha", "2 AS slot", "3 AS prior")
    return df, truth


def test_copies_share_a_vote_and_the_truth_is_found(spark):
    df, truth = answers(spark)
    learned = consensus.learned_tasks(df)
    got = {r.item_id: r.label for r in consensus.consensus(df, learned=learned).where("field = 'devanagari'").collect()}
    right = sum(got[k] == t for k, t in truth.items() if k in got) / len(got)
    assert len(got) == len(truth) and right > 0.9
    rel = {(r.provider_id, r.field): r for r in consensus.reliability(df, learned=learned).collect()}
    assert all(abs(rel[w, "devanagari"].weight - 0.5) < 1e-9 for w in ("e", "copy0")) and rel["a", "devanagari"].weight == 1
    assert rel["a", "devanagari"].skill > rel["d", "devanagari"].skill
    chances = consensus.posteriors(learned).groupBy("item_id", "field", "slot").sum("chance").collect()
    assert all(abs(r[3] - 1) < 1e-9 for r in chances)
    assert consensus.difficulty(learned).where("ease <= 0 OR difficulty <= 0").count() == 0


def test_skills_joined_instead_of_carried(spark):
    df, _ = answers(spark, 40)
    t = consensus.cut(consensus.tasks(consensus.usable_answers(df)))
    one, two = (sorted((r.item_id, r.field, r.slot, r.token, round(r.chance, 9)) for r in consensus.posteriors(consensus.learn(t, 4, n)).collect()) for n in (consensus.CARRIED, 2))
    assert one == two and one


def test_empty(spark):
    df, _ = answers(spark, 5)
    none = df.where("false")
    assert consensus.consensus(none).count() == consensus.agreement(none).count() == consensus.reliability(none).count() == 0
