"""Problem 9: long exact spans shared between records.

Method: winnowed k-mer seeds that two texts share are joined, grown to exact stretches, chained in order with gap costs
through a Fenwick tree, and the gaps aligned; a chain with an exact stretch of the wanted length links two texts. Where
more than two texts share a seed, or two share it several times, their pairs aren't tried one by one: every window of
the wanted length around such seeds becomes a seed of its own, so that only texts that share a span meet.

Exact copies are one class: seeds, pairs and chains work on classes, members are expanded at the end only. How much of
a text stands elsewhere is counted without pairs: word for word from the windows, in fuzzy passages from links, each the
last window of one exact stretch and the first of the next, by which all texts that have both meet at once.
"""

from __future__ import annotations

import bisect
import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filtered, cut

SPAN = 120
K = 60
GAP_COST = 0.5
#: Longest gap between two exact stretches of a fuzzy passage, in characters.
GAP = 200

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BI = np.uint64(pow(int(_B), -1, 1 << 64))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def kmer_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k code points, by prefix sums of a polynomial modulo 2**64."""
    n = len(points)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(_B, n), _powers(_BI, n - k + 1)
    mixed = (points.astype(np.uint64) + np.uint64(0x51ED27)) * np.uint64(0xD6E8FEB86659FD93)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mixed * up, out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each window of w values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = f(out[:-step], out[step:])
        have += step
    return out


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least value of some window of w: each window has one."""
    if len(h) < w:
        return np.flatnonzero(h == h.min()) if len(h) else np.empty(0, dtype=np.int64)
    least = _sliding(h, w, np.minimum)
    pad = np.zeros(w - 1, dtype=h.dtype)
    best = _sliding(np.concatenate([pad, least, pad]), w, np.maximum)
    return np.flatnonzero(best == h)


def seeds_of(texts: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, position, hash) of the winnowed seeds of many texts at once."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = kmer_hashes(points, k)
    if not len(h):
        e = np.empty(0, dtype=np.int64)
        return e, e, h
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for e in starts[1:-1]:  # windows over the end of a text
        h[max(0, e - k + 1) : e] = _TOP
    at = winnow(h, w)
    at = at[h[at] != _TOP]
    doc = np.searchsorted(starts, at, side="right") - 1
    return doc, at - starts[doc], h[at]


def seed_table(docs: DataFrame, k: int = K, span: int = SPAN) -> DataFrame:
    """(h, c, p) of docs (c, text): places of seeds that stand in more than one class, all of them. Any span of ``span``
    characters holds a window of span - k + 1 seeds, so that two texts that share it share a seed in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.drop_duplicates("c")  # copies within a batch are dropped before the shuffle
            cs, texts = b["c"].to_numpy(), list(b["text"])
            at = 0
            while at < len(texts):  # by about a million characters
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < 1_000_000):
                    size += len(texts[end])
                    end += 1
                doc, pos, h = seeds_of(texts[at:end], k, span - k + 1)
                yield pd.DataFrame({"h": h.view(np.int64), "c": cs[at:end][doc], "p": pos.astype(np.int32)})
                at = end

    seeds = docs.mapInPandas(run, "h long, c long, p int")
    several = cut(seeds.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h"))
    # made a second time rather than kept: the few that are shared are picked out before anything is shuffled
    return cut(bit_filtered(seeds, "h", several, "h").join(several, "h").dropDuplicates(["h", "c", "p"]))


def seed_groups(seeds: DataFrame) -> DataFrame:
    """(h, lo, hi, simple) of shared seeds: the least and greatest class; simple: no other class, and in one of the two the
    seed stands once."""
    each = seeds.groupBy("h", "c").agg(F.count("*").alias("k"))
    return each.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), ((F.count("*") == 2) & (F.min("k") == 1)).alias("simple"))


class Fenwick:
    """Greatest (value, item) among positions up to one."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(0.0, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def get(self, i: int) -> tuple[float, int]:
        """Over positions below i."""
        out = (0.0, -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chains(parts: list[tuple[int, int, int]], cost: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """All parts in chains, best first: both starts rise, and a chain's score is its length less ``cost`` for
    each character of the gaps."""
    left, out = sorted(set(parts)), []
    while left:
        ends = sorted({b + n for _, b, n in left})
        rank = {e: i for i, e in enumerate(ends)}
        tree, score, back = Fenwick(len(ends)), [0.0] * len(left), [-1] * len(left)
        events = sorted([(a, 1, i) for i, (a, _, _) in enumerate(left)] + [(a + n, 0, i) for i, (a, _, n) in enumerate(left)])
        for _, opens, i in events:
            a, b, n = left[i]
            if opens:
                lo, hi = 0, len(ends)
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if ends[mid] <= b else (lo, mid)
                got, j = tree.get(lo)
                gain = got - cost * (a + b)
                score[i], back[i] = (n + gain, j) if j >= 0 and gain > 0 else (float(n), -1)
            else:  # a part may be continued once it has ended
                tree.put(rank[b + n], (score[i] + cost * (a + n + b + n), i))
        i = max(range(len(left)), key=lambda i: score[i])
        chain = []
        while i >= 0:
            chain.append(left[i])
            i = back[i]
        out.append(chain[::-1])
        gone = set(chain)
        left = [x for x in left if x not in gone]
    return out


def _windows(texts: DataFrame, seeds: DataFrame, k: int, span: int) -> DataFrame:
    """(w, w2, c, p, before, after): every window of ``span`` characters around a shared seed, by two hashes, and the
    characters on either side, NULL at an end of the text."""
    places = seeds.groupBy("c").agg(F.collect_set("p").alias("ps"))  # as many as one text has

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, text, ps in zip(b["c"], b["text"], b["ps"], strict=True):
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                # of seed at p all windows that hold it
                near = np.zeros(len(points) + 1, dtype=np.int32)
                ps = np.asarray(ps, dtype=np.int64)
                np.add.at(near, np.maximum(ps - (span - k), 0), 1)
                np.add.at(near, np.minimum(ps + 1, len(points)), -1)
                at = np.flatnonzero(np.cumsum(near)[: len(points) - span + 1] > 0)
                w, w2 = kmer_hashes(points, span)[at], kmer_hashes(points[::-1] * np.uint32(31) + np.uint32(7), span)[::-1][at]
                around = np.concatenate([[-1], points.astype(np.int32), [-1]]).astype(np.int32)
                yield pd.DataFrame({"w": w.view(np.int64), "w2": w2.view(np.int64), "c": np.full(len(at), c, dtype=np.int64), "p": at.astype(np.int32), "before": around[at], "after": around[at + span + 1]})

    got = bit_filtered(texts, "c", seeds, "c").join(places, "c").dropDuplicates(["c"]).mapInPandas(run, "w long, w2 long, c long, p int, before int, after int")
    return got.withColumns({x: F.expr(f"nullif({x}, -1)") for x in ("before", "after")})


def _who():
    """Which classes a group holds, as often as each stands in it: sums, since in an XOR a class that stands twice is none."""
    h = F.xxhash64("c")
    return F.struct(F.sum(F.shiftright(h, 32)).alias("a"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("b"))


def window_table(texts: DataFrame, seeds: DataFrame, k: int = K, span: int = SPAN) -> DataFrame:
    """(w, w2, c, p, lo, who, times): every window of ``span`` characters around a shared seed, by two hashes, that stands
    in more than one class; who: which classes, as often as each has it."""
    windows = cut(_windows(texts, seeds, k, span).drop("before", "after"))
    several = windows.groupBy("w", "w2").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), _who().alias("who"), F.count("*").alias("times")).where("lo <> hi")
    return windows.join(several, ["w", "w2"]).select("w", "w2", "c", "p", "lo", "who", "times")


def edge_table(texts: DataFrame, span: int) -> DataFrame:
    """(w, w2, c, p, ends, begins): windows of ``span`` characters in more than one class that don't everywhere go on, or
    weren't everywhere begun, by the same character: the last and first of each exact stretch of ``span`` or more."""
    k = (span + 1) // 2
    windows = cut(_windows(texts, seed_table(texts, k, span), k, span))
    several = windows.groupBy("w", "w2").agg(
        F.min("c").alias("lo"),
        F.max("c").alias("hi"),
        F.coalesce(F.min("after") != F.max("after"), F.lit(False)).alias("ends"),
        F.coalesce(F.min("before") != F.max("before"), F.lit(False)).alias("begins"),
    )
    return windows.join(several.where("lo <> hi AND (ends OR begins)").drop("lo", "hi"), ["w", "w2"]).drop("before", "after")


def starts(windows: DataFrame) -> DataFrame:
    """Windows at which a shared run begins: those whose classes aren't those of the window before it in the text of the
    least class. The rest would only repeat the pairs of the window they follow."""
    lead = windows.where("c = lo")
    by = Window.partitionBy("c").orderBy("p")
    before = F.struct("p", "who", "times", "lo")
    told = lead.withColumn("b", F.lag(before).over(by))
    follows = (F.col("b.p") == F.col("p") - 1) & (F.col("b.who") == F.col("who")) & (F.col("b.times") == F.col("times")) & (F.col("b.lo") == F.col("lo"))
    first = told.groupBy("w", "w2").agg(F.min(F.coalesce(follows, F.lit(False)).cast("int")).alias("f")).where("f = 0")
    return windows.join(first.select("w", "w2"), ["w", "w2"])


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, c, c2): the class of exact copies of each text of at least ``span`` characters, named by two
    hashes. NULL ids and NULL or shorter texts have none; repeated rows count once."""
    t = F.col(f"`{text}`")
    return (
        docs.where(F.char_length(t) >= span)
        .select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(t).alias("c"), F.xxhash64(F.lit("again"), t).alias("c2"))
        .where("doc_id IS NOT NULL")
    )


def _named(docs: DataFrame, doc_id: str, text: str, span: int) -> DataFrame:
    t = F.col(f"`{text}`")
    long_enough = docs.where(F.char_length(t) >= span).where(F.col(f"`{doc_id}`").isNotNull())
    return long_enough.select(F.xxhash64(t).alias("c"), t.alias("text"))


def _in_chains(windows: DataFrame, span: int) -> DataFrame:
    """(ca, cb): pairs of classes that share a window, by the chains of their shared runs. As many pairs as there are to
    report: each shares a span."""
    runs = starts(windows).groupBy("w", "w2", "c").agg(F.min("p").alias("p"))
    other = runs.select("w", "w2", F.col("c").alias("cb"), F.col("p").alias("q"))
    met = runs.withColumnRenamed("c", "ca").join(other, ["w", "w2"]).where("ca < cb")
    pairs = met.groupBy("ca", "cb").agg(F.collect_set(F.struct("p", "q")).alias("m"))  # as many as two texts have

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            keep = [any(n >= span for c in chains([(int(i["p"]), int(i["q"]), span) for i in m]) for _, _, n in c) for m in x["m"]]
            yield x.loc[keep, ["ca", "cb"]]

    return pairs.mapInPandas(run, "ca long, cb long")


def class_pairs(texts: DataFrame, seeds: DataFrame, k: int = K, span: int = SPAN) -> DataFrame:
    """(ca, cb), ca < cb: pairs of classes with an exact span in common. Of ``seeds`` those that one pair shares are
    compared at once; for the others the windows around them decide."""
    groups = cut(seed_groups(seeds))
    placed = seeds.join(groups, "h")
    a = placed.where("simple AND c = lo").select("h", F.col("c").alias("ca"), F.col("p"))
    b = placed.where("simple AND c = hi").select("h", F.col("c").alias("cb"), F.col("p").alias("q"))
    stars = a.join(b, "h").groupBy("ca", "cb").agg(F.collect_list(F.struct("p", "q")).alias("m"))  # as many as two texts have
    few = placed.where("simple").select("c", "p")
    found = _compared(stars, clipped(texts, few, k, span), k, span).where(F.col("exact") >= span).select("ca", "cb")
    many = placed.where("NOT simple").select("c", "p")
    return found.unionByName(_in_chains(window_table(texts, many, k, span), span)).distinct()


def sharing_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, span: int = SPAN) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents with an exact span of at least ``span`` characters in common. Copies and
    spans are told by 128 bits of hash, the texts whose windows are compared by 64."""
    _check(k, span)
    members = cut(classes(docs, doc_id, text, span).distinct())
    texts = _named(docs, doc_id, text, span)
    linked = cut(class_pairs(texts, seed_table(texts, k, span), k, span))
    a = members.select(F.col("doc_id").alias("x"), F.col("c").alias("ca"), F.col("c2").alias("ca2"))
    b = members.select(F.col("doc_id").alias("y"), F.col("c").alias("cb"), F.col("c2").alias("cb2"))
    across = linked.join(a, "ca").join(b, "cb").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    within = a.join(b, (a.ca == b.cb) & (a.ca2 == b.cb2) & (a.x < b.y)).select(F.col("x").alias("doc_id_a"), F.col("y").alias("doc_id_b"))
    return across.where("doc_id_a < doc_id_b").unionByName(within).distinct()


def sharing_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, span: int = SPAN) -> DataFrame:
    """(doc_id, class_id, copies, links): each document's class of exact copies, its number of other copies and the number
    of other texts it shares a span with. One row a document, however many pairs there are."""
    _check(k, span)
    members = cut(classes(docs, doc_id, text, span).select("doc_id", "c").distinct())
    texts = _named(docs, doc_id, text, span)
    linked = cut(class_pairs(texts, seed_table(texts, k, span), k, span))
    links = linked.select(F.col("ca").alias("c")).unionByName(linked.select(F.col("cb").alias("c"))).groupBy("c").agg(F.count("*").alias("links"))
    copies = members.groupBy("c").agg((F.count("*") - 1).alias("copies"))
    got = members.join(copies, "c").join(links, "c", "left")
    return got.select("doc_id", F.col("c").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def _check(k: int, span: int) -> None:
    if not 0 < k <= span:
        raise ValueError("k must be from 1 to span")


# --- fuzzy passages ---------------------------------------------------------------------------------
def _snippets(text: str, ps: list[int], k: int, gap: int, span: int = SPAN) -> list[tuple[int, str]]:
    """The text from the first seed of each group of near ones to the end of its last, and on either side as much as a
    seed may lie inside a span."""
    out: list[list[int]] = []
    for p in sorted(ps):
        if out and p - out[-1][1] <= gap:
            out[-1][1] = p + k
        else:
            out.append([p, p + k])
    side = span - k
    return [(max(0, a - side), text[max(0, a - side) : b + side]) for a, b in out]


def _together(a: str, b: str) -> int:
    """How many characters two texts have in common from the start."""
    if a == b:
        return len(a)
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


class _Clips:
    """Stretches of a text by their places in it."""

    def __init__(self, clips: list[tuple[int, str]]) -> None:
        self.starts = [a for a, _ in clips]
        self.texts = [t for _, t in clips]

    def at(self, p: int) -> tuple[int, str]:
        i = bisect.bisect_right(self.starts, p) - 1
        return self.starts[i], self.texts[i]

    def piece(self, start: int, end: int) -> str:
        at, t = self.at(start)
        return t[start - at : end - at] if end <= at + len(t) else ""


def grown(a: _Clips, b: _Clips, matches: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the exact stretches around seed matches, as far as the clips reach. Matches
    whose characters differ, by a clash of hashes, are left out."""
    out: list[tuple[int, int, int]] = []
    done: dict[int, int] = {}
    for p, q in sorted(set(matches)):
        if p + k <= done.get(p - q, -1):
            continue
        (oa, ta), (ob, tb) = a.at(p), b.at(q)
        x, y = p - oa, q - ob
        if ta[x : x + k] != tb[y : y + k]:
            continue
        left = _together(ta[:x][::-1], tb[:y][::-1])
        right = _together(ta[x + k :], tb[y + k :])
        done[p - q] = p + k + right
        out.append((p - left, q - left, left + k + right))
    return out


def aligned(a: list[tuple[int, str]], b: list[tuple[int, str]], matches: list[tuple[int, int]], k: int, span: int, gap: int = GAP) -> list[tuple[int, int, int, int, int, int]]:
    """Passages (a0, a1, b0, b1, equal characters, longest exact stretch) of at least ``span`` characters: the stretches
    around seed matches in chains, cut where a gap is longer than ``gap``, the other gaps aligned."""
    ca, cb = _Clips(a), _Clips(b)
    out = []
    for chain in chains(grown(ca, cb, matches, k)):
        runs = [[chain[0]]]
        for x in chain[1:]:
            p, q, n = runs[-1][-1]
            runs[-1].append(x) if max(x[0] - p - n, x[1] - q - n) <= gap else runs.append([x])
        for run in runs:
            (a0, b0, _), (pa, pb, n) = run[0], run[-1]
            a1, b1 = pa + n, pb + n
            if max(a1 - a0, b1 - b0) < span:
                continue
            same = sum(n for _, _, n in run)
            for (p, q, n), (p2, q2, _) in zip(run, run[1:], strict=False):
                ga, gb = ca.piece(p + n, p2), cb.piece(q + n, q2)
                if ga and gb:
                    same += sum(m.size for m in difflib.SequenceMatcher(None, ga, gb, autojunk=False).get_matching_blocks())
            out.append((a0, a1, b0, b1, same, max(n for _, _, n in run)))
    return out


def clipped(texts: DataFrame, seeds: DataFrame, k: int, span: int, gap: int = GAP) -> DataFrame:
    """(c, s): the stretches of each class around its shared seeds."""
    places = seeds.groupBy("c").agg(F.collect_set("p").alias("ps"))  # as many as one text has

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, [{"at": a, "text": t} for a, t in _snippets(text, [int(p) for p in ps], k, gap, span)]) for c, text, ps in zip(b["c"], b["text"], b["ps"], strict=True)]
            yield pd.DataFrame(rows, columns=["c", "s"])

    return cut(bit_filtered(texts, "c", seeds, "c").join(places, "c").dropDuplicates(["c"]).mapInPandas(clip, "c long, s array<struct<at:int,text:string>>"))


_COMPARED = "ca long, cb long, a0 int, a1 int, b0 int, b1 int, same int, exact int"


def _compared(stars: DataFrame, clips: DataFrame, k: int, span: int, gap: int = GAP) -> DataFrame:
    """(ca, cb, a0, a1, b0, b1, same, exact): the passages of pairs (ca, cb, m)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for ca, cb, m, sa, sb in zip(x["ca"], x["cb"], x["m"], x["sa"], x["sb"], strict=True):
                a, b = ([(int(i["at"]), i["text"]) for i in s] for s in (sa, sb))
                rows += [(ca, cb, *f) for f in aligned(a, b, [(int(i["p"]), int(i["q"])) for i in m], k, span, gap)]
            yield pd.DataFrame(rows, columns=["ca", "cb", "a0", "a1", "b0", "b1", "same", "exact"])

    both = stars.join(clips.select(F.col("c").alias("ca"), F.col("s").alias("sa")), "ca").join(clips.select(F.col("c").alias("cb"), F.col("s").alias("sb")), "cb")
    return both.mapInPandas(run, _COMPARED)


def _repeats(t: str) -> bool:
    """Whether ``t`` is one pattern of up to half its length over and over."""
    return any(t[n:] == t[:-n] for n in range(1, len(t) // 2 + 1))


def _links(texts: DataFrame, edges: DataFrame, half: int, span: int, gap: int) -> DataFrame:
    """(x, y, c, p, q, laps, left, right): places p, q in a text of the last window of one exact stretch and the first of
    another up to ``gap`` characters on, named by two hashes, that more than one class has; how much the stretches lap in
    any of its texts, and the text before p, turned round, and after the window at q, as far as is needed."""
    places = edges.groupBy("c").agg(F.collect_list(F.struct("p", "w", "w2", "ends", "begins")).alias("m"))  # as many as one text has
    reach = half + gap
    names = ["w", "w2", "v", "v2"]

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, text, m in zip(b["c"], b["text"], b["m"], strict=True):
                m = sorted((i["p"], i["w"], i["w2"], i["ends"], i["begins"]) for i in m)
                at = np.array([i[0] for i in m], dtype=np.int64)
                w, w2 = (np.array([i[j] for i in m], dtype=np.int64) for j in (1, 2))
                last = np.flatnonzero([i[3] for i in m])
                first = np.flatnonzero([i[4] for i in m])
                dull = np.array([_repeats(text[p : p + half]) for p in at.tolist()], dtype=bool)
                before = np.concatenate([[0], np.cumsum(dull)])
                # lapping by more than gap + span adds nothing: one of the two is a span then and holds the other
                lo = np.searchsorted(at[first], at[last] + half - gap - span)
                hi = np.searchsorted(at[first], at[last] + reach, side="right")
                for s in range(0, len(last), 1000):
                    n = (hi - lo)[s : s + 1000]
                    i = np.repeat(last[s : s + 1000], n)
                    j = first[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[s : s + 1000], n)]
                    both = dull[i] & dull[j]
                    keep = (at[j] - at[i] >= half) | ~both & (before[np.maximum(i + 1, j)] == before[j])
                    i, j, both = i[keep], j[keep], both[keep]
                    x = pd.DataFrame({"w": w[i], "w2": w2[i], "v": w[j], "v2": w2[j], "c": np.full(len(i), c, dtype=np.int64), "p": at[i].astype(np.int32), "q": at[j].astype(np.int32)})
                    if both.any():  # what one p covers with the farthest q, it covers with all
                        far = x.q == x.groupby([*names, "p"]).q.transform("max")
                        near = x.p == x.groupby([*names, "q"]).p.transform("min")
                        x = x[~both | far | near]
                    yield x

    made = bit_filtered(texts, "c", edges, "c").join(places, "c").dropDuplicates(["c"]).mapInPandas(pairs, "w long, w2 long, v long, v2 long, c long, p int, q int")
    made = cut(made.select(F.xxhash64(*names).alias("x"), F.xxhash64(F.lit("again"), *names).alias("y"), "c", "p", "q"))
    d = F.col("q") - F.col("p")
    groups = made.groupBy("x", "y").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(d).alias("d0"), F.max(d).alias("d1"), F.collect_set(F.when(d < half, half - d)).alias("laps"))
    # where all lap alike it is one stretch
    groups = groups.where(f"lo <> hi AND (d1 >= {half} OR d0 <> d1)").select("x", "y", "laps")
    each = cut(made.join(groups, ["x", "y"]))
    by_text = each.groupBy("c").agg(F.collect_list(F.struct("x", "y", "p", "q", "laps")).alias("m"))  # as many as one text has

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, text, m in zip(b["c"], b["text"], b["m"], strict=True):
                for s in range(0, len(m), 5000):
                    rows = []
                    for i in m[s : s + 5000]:
                        p, end, far = i["p"], i["q"] + half, max([half, *i["laps"]])
                        rows.append((i["x"], i["y"], c, p, i["q"], i["laps"], text[max(0, p - far) : p][::-1], text[end : end + far]))
                    yield pd.DataFrame(rows, columns=["x", "y", "c", "p", "q", "laps", "left", "right"])

    return bit_filtered(texts, "c", each, "c").join(by_text, "c").dropDuplicates(["c"]).mapInPandas(around, "x long, y long, c long, p int, q int, laps array<int>, left string, right string")


def _reached(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with l and r: how far ``left`` and ``right`` go on as in any row of the same keys and another class. Only
    rows that have such. In order, the row that has most in common is the nearest of another class, before or after."""
    kept = rows.columns
    for side in ("left", "right"):
        for turn in ("asc", "desc"):
            by = Window.partitionBy(*keys).orderBy(getattr(F.col(side), turn)(), getattr(F.col("c"), turn)())
            rows = rows.withColumn("_new", F.when(F.lag("c").over(by) != F.col("c"), F.lag(side).over(by)))
            rows = rows.withColumn(f"{side}_{turn}", F.last("_new", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[kept].copy()
            for name, side in (("l", "left"), ("r", "right")):
                out[name] = np.array([max(_together(t, o) if isinstance(o, str) else 0 for o in (u, v)) for t, u, v in zip(b[side], b[f"{side}_asc"], b[f"{side}_desc"], strict=True)], dtype=np.int32)
            yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    return rows.where("left_asc IS NOT NULL OR left_desc IS NOT NULL").mapInPandas(run, f"{kinds}, l int, r int")


def _trimmed(links: DataFrame, half: int, gap: int) -> DataFrame:
    """Rows of ``links`` whose stretches lap in some text, once for each way to shorten the two by ``o`` together so that
    they don't: by t before p and by o - t after q, which must then be the same in both texts."""
    names = ["x", "y", "o", "t", "kl", "kr", "c", "p", "q", "left", "right"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for x, y, c, p, q, laps, left, right, far_l, far_r in b[["x", "y", "c", "p", "q", "laps", "left", "right", "l", "r"]].itertuples(index=False):
                for o in (0, *laps):
                    if 0 <= q - p - half + o <= gap:
                        rows += [(x, y, o, t, left[:t], right[: o - t], c, p, q, left[:half], right[:half]) for t in range(max(0, o - far_r), min(o, far_l) + 1)]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return links.mapInPandas(run, "x long, y long, o int, t int, kl string, kr string, c long, p int, q int, left string, right string")


def fuzzy_ranges(texts: DataFrame, span: int = SPAN, gap: int = GAP) -> DataFrame:
    """(c, s, e): what two exact stretches of half a span or more each cover, with the gap between them, wherever any other
    text has the two in the same order and neither text more than ``gap`` characters between. Stretches that lap in a text
    are shortened, but not where both meet in a repeated pattern, such as a ruled line. Of a stretch of a span or more only half a span beyond its end: it stands word for word elsewhere."""
    half = (span + 1) // 2
    links = cut(_reached(_links(texts, edge_table(texts, half), half, span, gap), ["x", "y"]))
    lapped = _reached(_trimmed(links.where("size(laps) > 0"), half, gap), ["x", "y", "o", "t", "kl", "kr"])
    plain = links.where("size(laps) = 0")
    return plain.select("c", "p", "q", "l", "r").unionByName(lapped.select("c", "p", "q", "l", "r")).select("c", (F.col("p") - F.least("l", F.lit(half))).alias("s"), (F.col("q") + half + F.least("r", F.lit(half))).alias("e"))


def _covered(ranges: DataFrame, name: str) -> DataFrame:
    """(c, name, name_parts): characters in the union of ranges (c, s, e) and how many stretches they make."""
    by = Window.partitionBy("c").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("e").over(by)
    new = ranges.withColumn("b", before)
    got = new.groupBy("c").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce("b", F.lit(0))))).alias(name), F.count_if(F.col("b").isNull() | (F.col("s") > F.col("b"))).alias(f"{name}_parts"))
    return got


def shared_amount(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, span: int = SPAN) -> DataFrame:
    """(doc_id, n_chars, copies, passages, verbatim_chars, verbatim, fuzzy_chars, fuzzy): for each document how many copies
    it has besides itself, how many stretches of it stand word for word in other texts, how many characters these are and
    what share of the text; and the same of what fuzzy passages cover, shared with any other text (``fuzzy_ranges``). A
    document with a copy stands elsewhere as a whole. NULL texts have n_chars NULL and share nothing, as do texts shorter
    than ``span``."""
    _check(k, span)
    texts = _named(docs, doc_id, text, span)
    seeds = seed_table(texts, k, span)
    windows = window_table(texts, seeds, k, span)
    exact = _covered(windows.select("c", F.col("p").alias("s"), (F.col("p") + span).alias("e")), "v")
    # what is shared word for word is part of the fuzzy passages too
    sides = fuzzy_ranges(texts, span).unionByName(windows.select("c", F.col("p").alias("s"), (F.col("p") + span).alias("e")))
    loose = _covered(sides, "f")
    t = F.col(f"`{text}`")
    members = classes(docs, doc_id, text, span).select("doc_id", "c").distinct()
    copies = members.groupBy("c").agg((F.count("*") - 1).alias("copies"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.char_length(t).alias("n_chars"), F.xxhash64(t).alias("c")).distinct()
    rows = rows.join(copies, "c", "left").join(exact, "c", "left").join(loose, "c", "left")
    copied = F.coalesce(F.when(F.col("n_chars") >= span, F.col("copies")), F.lit(0))

    def amount(name: str):
        return F.when(copied > 0, F.col("n_chars")).otherwise(F.coalesce(name, F.lit(0))).cast("int")

    def share(x):
        return F.when(F.col("n_chars") > 0, x / F.col("n_chars")).otherwise(0.0)

    return rows.select(
        "doc_id",
        "n_chars",
        copied.alias("copies"),
        F.coalesce("v_parts", F.lit(0)).alias("passages"),
        amount("v").alias("verbatim_chars"),
        share(amount("v")).alias("verbatim"),
        amount("f").alias("fuzzy_chars"),
        share(amount("f")).alias("fuzzy"),
    )
