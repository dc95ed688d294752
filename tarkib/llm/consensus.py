"""Problem 2: consensus from several annotators' labels.

Method: latent ability-difficulty estimation. Every word slot of an item is a task; gradient
expectation-maximisation learns each annotator's skill and each task's difficulty together, P(right) being
sigmoid(skill x ease). Annotators whose mistakes coincide too often share one vote.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import canon, cut, words
from .graphs import components

FIELDS = ("devanagari", "roman")
LEAST = 3
ROUNDS = 12
#: Up to so many (annotator, field) the skills, some 50 bytes each, go with the tasks' function; more are joined to the
#: votes. The results are the same.
CARRIED = 100_000
#: Annotators that repeat each other: least of the tasks both answered and one got wrong on which both gave the same wrong
#: answer, and least number of these. Independent ones of the kinds met are below 0.2, copies above 0.6.
SAME, LEAST_SAME = 0.35, 3
#: Minima of so many hashes of its wrong answers describe an annotator.
HASHES = 32


def clean(text: str | None, field: str) -> str | None:
    """The value of an answer as a label; NULL if nothing is left."""
    c = canon(text)
    if c is None:
        return None
    c = re.sub(r"\s+", " ", c).strip()
    c = unicodedata.normalize("NFC", c.lower() if field == "roman" else c)
    return c or None


def usable_answers(answers: DataFrame, fields: tuple[str, ...] = FIELDS, least: int = LEAST) -> DataFrame:
    """(item_id, field, answers): the answers of each item and field with at least ``least`` annotators. Of an
    annotator only the latest answer counts (``created_at``, then ``result_id``; NULL is earliest); it must be
    ok and not NULL or blank. NULL items or annotators are left out, repeated rows count once."""
    latest = (
        answers.where("item_id IS NOT NULL AND provider_id IS NOT NULL")
        .groupBy("item_id", "provider_id")
        .agg(F.max_by(F.struct("ok", *fields), F.struct("created_at", "result_id")).alias("last"))
        .where("last.ok")
    )

    @F.pandas_udf("string")
    def cleaned(text: pd.Series, field: pd.Series) -> pd.Series:
        return pd.Series([clean(t if isinstance(t, str) else None, f) for t, f in zip(text, field, strict=True)], dtype=object)

    rows = latest.select("item_id", "provider_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"last.{f}").alias("text")) for f in fields])).alias("x"))
    rows = rows.select("item_id", "provider_id", "x.field", cleaned("x.text", "x.field").alias("label")).where("label IS NOT NULL")
    packed = rows.groupBy("item_id", "field").agg(F.sort_array(F.collect_list(F.struct("provider_id", "label"))).alias("answers"))
    return packed.where(F.size("answers") >= least)


def _project(text: str, onto: str) -> list[str]:
    """Pieces of ``text``, one for each word of ``onto``, cut where the letters line up."""
    flat, ref = text.replace(" ", ""), onto.split(" ")
    target = "".join(ref)
    cuts, at = [], 0
    for w in ref[:-1]:
        at += len(w)
        cuts.append(at)
    out, last = [], 0
    blocks = difflib.SequenceMatcher(None, target, flat, autojunk=False).get_matching_blocks()
    for c in cuts:
        place = None
        for b in blocks:
            if b.a <= c <= b.a + b.size and b.size:
                place = b.b + (c - b.a)
                break
            if b.a > c:
                place = b.b
                break
        place = max(last, len(flat) if place is None else place)
        out.append(flat[last:place])
        last = place
    return [*out, flat[last:]]


def slots(labels: list[str]) -> list[list[str]]:
    """For each answer its words, as many for all: the commonest number of words holds, other answers are cut
    to fit the answer of that number nearest to all (ties: the more common, then the lesser text)."""
    sizes = Counter(len(x.split(" ")) for x in labels)
    n = max(sizes, key=lambda k: (sizes[k], k))
    fitting = sorted(x for x in labels if len(x.split(" ")) == n)
    if len(set(fitting)) > 1 and len(fitting) < len(labels):
        ref = max(sorted(set(fitting)), key=lambda x: (fitting.count(x), sum(difflib.SequenceMatcher(None, x, y).ratio() for y in labels)))
    else:
        ref = fitting[0]
    return [x.split(" ") if len(x.split(" ")) == n else _project(x, ref) for x in labels]


_TASKS = "item_id long, field string, slot int, word string, tokens array<string>, who array<string>, said array<int>"


def tasks(packed: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(item_id, field, slot, word, tokens, who, said): a task for each word slot: candidate readings, the
    annotators and which candidate each gave. ``word``: the item's own word there, if the numbers agree."""
    if items is not None:
        packed = packed.join(items.select("item_id", "urdu").groupBy("item_id").agg(F.min("urdu").alias("urdu")), "item_id", "left")
    else:
        packed = packed.withColumn("urdu", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                who = [x["provider_id"] for x in r.answers]
                said = slots([x["label"] for x in r.answers])
                source = words(r.urdu) if isinstance(r.urdu, str) else []
                for k, given in enumerate(zip(*said, strict=True)):
                    tokens = sorted(set(given))
                    word = source[k] if len(source) == len(said[0]) else None
                    out.append((r.item_id, r.field, k, word, tokens, who, [tokens.index(x) for x in given]))
            yield pd.DataFrame(out, columns=["item_id", "field", "slot", "word", "tokens", "who", "said"])

    return packed.select("item_id", "field", "answers", "urdu").mapInPandas(run, _TASKS)


def _estimate(b: pa.RecordBatch) -> tuple:
    """One expectation step over a batch with columns alpha and share, the tasks' ease learned within: flat arrays of the
    votes (annotator, field, task, answer, chance of being right, its chance by skill, ease, share) and of the
    candidates' posteriors with their tasks' bounds, and the ease of each task."""
    said = b.column("said")
    start = np.asarray(said.offsets)
    start = start - start[0]
    n, size = len(b), np.diff(start)
    task = np.repeat(np.arange(n), size)
    given = np.asarray(said.flatten()).astype(np.int64)
    alpha, share = (np.asarray(b.column(c).flatten(), dtype=float) for c in ("alpha", "share"))
    kinds = np.diff(np.asarray(b.column("tokens").offsets))
    first = np.concatenate([[0], np.cumsum(kinds)])
    cand, owner = first[task] + given, np.repeat(np.arange(n), kinds)
    prior = np.log(np.maximum(np.asarray(b.column("prior").flatten(), dtype=float), 1e-6))
    wrong_kinds = np.log(np.maximum(kinds, 3))[task]
    ease = np.zeros(n)
    for _ in range(4):
        x = alpha * np.exp(ease)[task]
        right = -np.logaddexp(0, -x)
        wrong = -np.logaddexp(0, x) - wrong_kinds
        score = prior + np.bincount(cand, weights=share * (right - wrong), minlength=len(owner))
        score -= np.maximum.reduceat(score, first[:-1])[owner] if n else 0
        post = np.exp(score)
        post /= np.bincount(owner, weights=post, minlength=n)[owner]
        p, s = post[cand], np.exp(right)
        grad = np.bincount(task, weights=share * x * (p - s), minlength=n) - ease
        curve = np.bincount(task, weights=share * x * x * s * (1 - s), minlength=n) + 1
        ease = np.clip(ease + np.clip(grad / curve, -0.7, 0.7), -3, 3)
    names = pd.DataFrame({"who": b.column("who").flatten().to_pandas(), "field": pd.Series(b.column("field").to_pandas().to_numpy()[task], dtype=object)})
    return names, task, given, p, s, np.exp(ease)[task], post, owner, first, ease


_SKILLS = "who string, field string, alpha double, share double"
#: Skills (who, field, alpha, share): held by the driver where there are few, a table where there are many.
Skills = pd.DataFrame | DataFrame


def _held(skills: DataFrame, carried: int) -> Skills:
    """At most ``carried`` rows as they are, more as a table."""
    skills = cut(skills)
    few = skills.limit(carried + 1).toPandas()
    return few if len(few) <= carried else skills


def with_skills(tasks_: DataFrame, skills: Skills) -> DataFrame:
    """``tasks_`` with arrays alpha and share beside ``who``: each annotator's skill and the weight of its vote, 1 and 1
    for one not in ``skills``."""
    if isinstance(skills, pd.DataFrame):
        table = {(w, f): (a, s) for w, f, a, s in skills.itertuples(index=False)}

        def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                offsets = b.column("who").offsets
                size = np.diff(np.asarray(offsets))
                fields = np.repeat(b.column("field").to_pandas().to_numpy(), size)
                got = np.array([table.get(x, (1.0, 1.0)) for x in zip(b.column("who").flatten().to_pylist(), fields, strict=True)], dtype=float).reshape(-1, 2)
                at = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                for i, name in enumerate(("alpha", "share")):
                    b = b.append_column(name, pa.ListArray.from_arrays(at, pa.array(got[:, i].copy())))
                yield b

        return tasks_.mapInArrow(attach, _ddl(tasks_) + ", alpha array<double>, share array<double>")
    votes = tasks_.select("item_id", "field", "slot", F.posexplode("who").alias("k", "who"))
    met = votes.join(skills, ["who", "field"], "left").select("item_id", "field", "slot", F.struct("k", F.coalesce("alpha", F.lit(1.0)).alias("alpha"), F.coalesce("share", F.lit(1.0)).alias("share")).alias("x"))
    packed = met.groupBy("item_id", "field", "slot").agg(F.sort_array(F.collect_list("x")).alias("x"))  # as many as a task has votes
    packed = packed.select("item_id", "field", "slot", F.transform("x", lambda e: e["alpha"]).alias("alpha"), F.transform("x", lambda e: e["share"]).alias("share"))
    return tasks_.join(packed, ["item_id", "field", "slot"])


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def learn(tasks_: DataFrame, rounds: int = ROUNDS, carried: int = CARRIED) -> DataFrame:
    """The tasks with columns alpha, share and ``prior``, the latter the share of each candidate among the reliable votes on
    the same word in all items. ``tasks_`` should be cut."""
    plain = tasks_.withColumn("prior", F.transform("tokens", lambda _: F.lit(1.0)))
    none = pd.DataFrame({n: pd.Series(dtype=t) for n, t in (("who", object), ("field", object), ("alpha", float), ("share", float))})
    skills = _rounds(plain, none, rounds // 2, carried)
    skills = _held(_shared(with_skills(plain, skills), _table(tasks_, skills)), carried)
    pooled = cut(_pooled(with_skills(plain, skills)))
    skills = _rounds(pooled, skills, rounds - rounds // 2, carried)
    return cut(with_skills(pooled, skills))


def _table(tasks_: DataFrame, skills: Skills) -> DataFrame:
    return tasks_.sparkSession.createDataFrame(skills, _SKILLS) if isinstance(skills, pd.DataFrame) else skills


def _rounds(tasks_: DataFrame, skills: Skills, rounds: int, carried: int) -> Skills:
    """``skills`` after so many rounds: in each a Newton step of every annotator's skill, with a prior around 2."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, _, _, p, s, ease, *_ = _estimate(b)
            if len(names):
                d = names.assign(grad=ease * (p - s), curve=ease * ease * s * (1 - s))
                yield pa.RecordBatch.from_pandas(d.groupby(["who", "field"], as_index=False).sum(), preserve_index=False)

    for _ in range(rounds):
        got = with_skills(tasks_, skills).mapInArrow(step, "who string, field string, grad double, curve double")
        got = got.groupBy("who", "field").agg(F.sum("grad").alias("grad"), F.sum("curve").alias("curve"))
        few = got.limit(carried + 1).toPandas() if isinstance(skills, pd.DataFrame) else None
        if few is not None and len(few) <= carried:
            d = few.merge(skills, "left", ["who", "field"])
            old = d["alpha"].astype(float).fillna(1.0)
            move = ((d["grad"] - 0.5 * (old - 2.0)) / (d["curve"] + 0.5)).clip(-1.0, 1.0)
            skills = pd.DataFrame({"who": d["who"], "field": d["field"], "alpha": (old + move).clip(-2.0, 6.0), "share": d["share"].astype(float).fillna(1.0)})
            continue
        met = got.join(_table(tasks_, skills), ["who", "field"], "left")
        old = F.coalesce("alpha", F.lit(1.0))
        move = F.least(F.greatest((F.col("grad") - 0.5 * (old - 2.0)) / (F.col("curve") + 0.5), F.lit(-1.0)), F.lit(1.0))
        skills = cut(met.select("who", "field", F.least(F.greatest(old + move, F.lit(-2.0)), F.lit(6.0)).alias("alpha"), F.coalesce("share", F.lit(1.0)).alias("share")))
    return skills


def wrong_answers(tasks_: DataFrame) -> DataFrame:
    """(who, field, task, answer, wrong): every vote with hashes of its task and of the answer, and whether the estimate
    holds it for wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, task, given, p, *_ = _estimate(b)
            at = [b.column(c).to_pandas().to_numpy()[task] for c in ("item_id", "slot")]
            d = names.assign(item_id=at[0], slot=at[1], given=given.astype(np.int32), wrong=p < 0.5)
            yield pa.RecordBatch.from_pandas(d, preserve_index=False)

    got = tasks_.mapInArrow(run, "who string, field string, item_id long, slot int, given int, wrong boolean")
    return got.select("who", "field", F.xxhash64("item_id", "slot").alias("task"), F.xxhash64("item_id", "slot", "given").alias("answer"), "wrong")


def _shared(tasks_: DataFrame, skills: DataFrame) -> DataFrame:
    """``skills`` with the weight of each annotator's vote. Where two give the same wrong answer more often than careful
    but independent ones would, they repeat each other, and the group of such shares its votes.

    Annotators are described by minima of hashes of their wrong answers; each is compared with the least of those that
    agree in one of them, so that there are as many comparisons as annotators, not as pairs of them."""
    votes = cut(wrong_answers(tasks_))
    bad = votes.where("wrong").select("who", "field", "task", "answer").distinct()
    hashes = F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(HASHES)), lambda i: F.xxhash64(i, "answer")))
    flat = cut(bad.select("who", "field", hashes.alias("i", "h")).groupBy("who", "field", "i").agg(F.min("h").alias("m")))
    least = flat.groupBy("field", "i", "m").agg(F.min("who").alias("other"))
    pairs = cut(flat.join(least, ["field", "i", "m"]).where("who <> other").select("field", "who", "other").distinct())
    mine = pairs.join(bad, ["who", "field"])
    theirs = bad.select(F.col("who").alias("other"), "field", "task", F.col("answer").alias("b"))
    also = votes.select(F.col("who").alias("other"), "field", "task").distinct()
    one = mine.join(also, ["other", "field", "task"]).join(theirs, ["other", "field", "task"], "left")
    one = one.groupBy("field", "who", "other").agg(F.count_if(F.col("answer") == F.col("b")).alias("same"), F.count("*").alias("x"), F.count("b").alias("both"))
    two = pairs.join(theirs, ["other", "field"]).join(votes.select("who", "field", "task").distinct(), ["who", "field", "task"]).groupBy("field", "who", "other").agg(F.count("*").alias("y"))
    linked = one.join(two, ["field", "who", "other"]).where((F.col("same") >= LEAST_SAME) & (F.col("same") > SAME * (F.col("x") + F.col("y") - F.col("both"))))
    groups = components(linked.select(F.xxhash64("field", "who").alias("u"), F.xxhash64("field", "other").alias("v")))
    size = groups.groupBy("component").agg(F.count("*").alias("n"))
    weight = groups.join(size, "component").select("node", (1.0 / F.col("n")).alias("w"))
    named = skills.drop("share").withColumn("node", F.xxhash64("field", "who"))
    return named.join(weight, "node", "left").select("who", "field", "alpha", F.coalesce("w", F.lit(1.0)).alias("share"))


_ALL = ", prior array<double>, alpha array<double>, share array<double>"


def _pooled(tasks_: DataFrame) -> DataFrame:
    """Tasks with the prior of each candidate from all tasks on the same word. Votes are summed before the
    shuffle; a task's own votes are taken out again. A word that a third of all tasks ask for only meets its few
    candidates, and the join back may be split."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *_, post, _, first, _ = _estimate(b)
            yield b.append_column("own", pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(post)))

    kept = cut(tasks_.mapInArrow(own, _TASKS + _ALL + ", own array<double>").drop("prior", "alpha", "share"))
    flat = kept.where("word IS NOT NULL").select("item_id", "field", "slot", "word", F.posexplode(F.arrays_zip("tokens", "own")).alias("k", "x"))
    flat = flat.select("item_id", "field", "slot", "word", "k", F.col("x.tokens").alias("token"), F.col("x.own").alias("own"))
    mass = flat.groupBy("word", "field", "token").agg(F.sum("own").alias("mass"))
    flat = flat.join(mass, ["word", "field", "token"]).select("item_id", "field", "slot", F.struct("k", (F.greatest(F.col("mass") - F.col("own"), F.lit(0.0)) + 0.5).alias("v")).alias("kv"))
    prior = flat.groupBy("item_id", "field", "slot").agg(F.transform(F.sort_array(F.collect_list("kv")), lambda x: x["v"]).alias("p"))
    out = kept.join(prior, ["item_id", "field", "slot"], "left")
    return out.withColumn("prior", F.coalesce("p", F.transform("tokens", lambda _: F.lit(1.0)))).drop("p", "own")


def posteriors(learned: DataFrame) -> DataFrame:
    """(item_id, field, slot, token, chance): every candidate of each task with its chance of being right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *_, post, owner, _, _ = _estimate(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.column(c).to_pandas().to_numpy()[owner], t) for c, t in (("item_id", pa.int64()), ("field", pa.string()), ("slot", pa.int32()))] + [b.column("tokens").flatten(), pa.array(post)],
                names=["item_id", "field", "slot", "token", "chance"],
            )

    return learned.mapInArrow(run, "item_id long, field string, slot int, token string, chance double")


def difficulty(learned: DataFrame) -> DataFrame:
    """(item_id, field, slot, ease, difficulty): what was learned of each task; an ease of 1 is the prior's, difficulty is
    its inverse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ease = np.exp(_estimate(b)[-1])
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("field"), b.column("slot"), pa.array(ease), pa.array(1 / ease)], names=["item_id", "field", "slot", "ease", "difficulty"])

    return learned.mapInArrow(run, "item_id long, field string, slot int, ease double, difficulty double")


def learned_tasks(answers: DataFrame, items: DataFrame | None = None) -> DataFrame:
    return learn(cut(tasks(usable_answers(answers), items)))


def consensus(answers: DataFrame, items: DataFrame | None = None, learned: DataFrame | None = None) -> DataFrame:
    """(item_id, field, label, chance): the agreed reading of every item and field with enough usable answers: of each word
    the likeliest candidate, of equally likely ones the lesser text; chance is that of its least likely word.
    A single candidate is agreed with chance 1; an empty table gives an empty result."""
    every = posteriors(learned_tasks(answers, items) if learned is None else learned)
    best = every.groupBy("item_id", "field", "slot").agg(F.min(F.struct((-F.col("chance")).alias("c"), "token")).alias("b")).select("item_id", "field", "slot", "b.token", (-F.col("b.c")).alias("chance"))
    joined = best.groupBy("item_id", "field").agg(F.sort_array(F.collect_list(F.struct("slot", "token"))).alias("w"), F.min("chance").alias("chance"))
    label = F.trim(F.regexp_replace(F.array_join(F.transform("w", lambda x: x["token"]), " "), " {2,}", " "))
    return joined.select("item_id", "field", label.alias("label"), "chance")


def agreement(answers: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(item_id, field, annotators, observed, kappa): share of agreeing pairs of annotators over the words of
    an item, and the same set against the agreement by chance, (observed - chance) / (1 - chance), the chance
    being that two answers drawn from all of that field are equal (kappa NULL if it is 1)."""
    t = cut(tasks(usable_answers(answers), items))
    per = t.select("item_id", "field", F.size("said").alias("n"), F.explode("said").alias("v"), "slot").groupBy("item_id", "field", "slot", "n", "v").agg(F.count("*").alias("c"))
    per = per.groupBy("item_id", "field", "slot", "n").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("n > 1")
    seen = per.groupBy("item_id", "field").agg(F.max("n").cast("int").alias("annotators"), (F.sum("same") / F.sum(F.col("n") * (F.col("n") - 1))).alias("observed"))
    said = t.select("field", F.explode(F.transform("said", lambda i: F.element_at("tokens", i + 1))).alias("token")).groupBy("field", "token").agg(F.count("*").alias("c"))
    chance = said.groupBy("field").agg((F.sum(F.col("c").cast("double") * F.col("c")) / (F.sum("c").cast("double") * F.sum("c"))).alias("chance"))
    out = seen.join(F.broadcast(chance), "field")
    return out.select("item_id", "field", "annotators", "observed", F.when(F.col("chance") < 1, (F.col("observed") - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"))


def reliability(answers: DataFrame, items: DataFrame | None = None, learned: DataFrame | None = None) -> DataFrame:
    """(provider_id, field, skill, weight, words, right): the learned skill of each annotator, its vote's
    weight, the words it gave and the share of them expected to be right."""
    learned = learned_tasks(answers, items) if learned is None else learned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, _, _, p, *_ = _estimate(b)
            if len(names):
                alpha, share = (np.asarray(b.column(c).flatten(), dtype=float) for c in ("alpha", "share"))
                d = names.assign(skill=alpha, weight=share, n=1, p=p).groupby(["who", "field", "skill", "weight"], as_index=False).sum()
                yield pa.RecordBatch.from_pandas(d, preserve_index=False)

    got = learned.mapInArrow(run, "who string, field string, skill double, weight double, n long, p double")
    return got.groupBy(F.col("who").alias("provider_id"), "field", "skill", "weight").agg(F.sum("n").alias("words"), (F.sum("p") / F.sum("n")).alias("right"))
