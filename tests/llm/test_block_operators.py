"""Hard negatives, the divergence audit and exact search against brute force: nulls, ties, copies, hot keys, clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamiz.llm import divergence, integers, negatives, topk

VECTORS = "vec_id long, label string, embedding array<double>, row int, dim string, seq int, bound string, a int, place int, n int"
CLASH = (1, "d", 1, "b", 1, 1, 1)


def table(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], VECTORS).repartition(3)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(5, 12))
    rows = [(i, "abc"[i % 3], (base[i % 5] + 0.3 * rng.normal(size=12)).tolist()) for i in range(120)]
    rows += [(200 + i, "a", rows[10][2]) for i in range(60)]  # one vector in a third of the rows
    rows += [(20, "a", rows[20][2]), (20, "b", rows[21][2])]  # repeated ids
    odd = [None, [], [math.nan] + [1.0] * 11, [math.inf] * 12, [None] + [1.0] * 11, [1.0] * 5, [-1.0] * 5, [0.0] * 12, [1e300] * 12, [2e6] * 12]
    rows += [(300 + 10 * i, "a", v) for i, v in enumerate(odd)] + [(400, None, [1.0] * 12), (None, "a", [1.0] * 12), (410, "b", []), (411, "a", [])]
    return rows


def usable(rows, labelled=False):
    out = []
    for i, label, v in rows:
        if i is None or v is None or None in v or not all(map(math.isfinite, v)) or (labelled and label is None):
            continue
        x = [math.floor(256 * c) for c in v]
        if sum(c * c for c in x) < 2**62:
            out.append((i, label, x))
    return out


def score(x, y):
    return sum(a * b for a, b in zip(x, y, strict=True))


def test_exact_search(spark, vectors):
    got = Counter(map(tuple, topk.search(table(spark, vectors), F.col("vec_id") % 10 == 0, 4).collect()))
    rows, want = usable(vectors), Counter()
    for a, (i, _, x) in enumerate(rows):
        if i % 10 == 0:
            found = sorted((-score(x, y), j) for b, (j, _, y) in enumerate(rows) if b != a and len(x) == len(y))[:4]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(found))
    assert got == want
    assert (390, 1) in {(r[0], r[1]) for r in got} and 380 not in {r[k] for r in got for k in (0, 2)}
    assert topk.search(table(spark, vectors[:3]).limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_distant_blocks_and_vectors_are_not_computed(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = 4 * rng.normal(size=(30, 4)).repeat(8, axis=1)
    rows = [(i, "a", (centres[i % 30] + 0.1 * rng.normal(size=32)).tolist()) for i in range(1500)]
    monkeypatch.setattr(integers, "BLOCK", 64)
    blocks = integers.blocks
    monkeypatch.setattr(integers, "blocks", lambda *a, **k: blocks(*a, **{**k, "most": 64}) if len(a) < 6 else blocks(*a[:5], 32))
    monkeypatch.setattr(topk, "STRETCH", 4)
    passed = topk.found(table(spark, rows), F.col("vec_id") % 5 == 0, 3).cache()
    pairs, exact = passed.where("q is null").agg(F.sum("pairs"), F.sum("exact")).first()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.best(passed, 3).collect())
    a = np.floor(256 * np.array([r[2] for r in rows]))
    want = []
    for i in range(0, 1500, 5):
        s = a @ a[i]
        s[i] = -np.inf
        want += [(i, k + 1, int(j), int(s[j])) for k, j in enumerate(np.lexsort((np.arange(1500), -s))[:3])]
    assert got == want
    assert pairs < 0.6 * 300 * 1500 and exact < 0.25 * 300 * 1500
    # one list for each query and task at most
    assert passed.where("q is not null").count() <= 300 * 3 * 24


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for dim in (1, 2, 3, 5, 16, 33):
        x, y = (np.floor(300 * rng.normal(size=(20, dim))).astype(np.int64) for _ in range(2))
        exact = x @ y.T
        for n in (*topk.LEVELS, topk.COARSE, 1):
            bound = topk.statistics(x, n) @ topk.statistics(y, n).T
            assert (bound >= exact - 1e-6 * np.abs(exact).max()).all()


def test_best_keeps_the_smallest_ids_of_ties():
    rng = np.random.default_rng(3)
    for _ in range(30):
        best, seen = integers.Best(3, 4), defaultdict(list)
        for _ in range(4):
            s, ids, mask = rng.integers(-2, 3, size=(2, 50)), rng.permutation(200)[:50], rng.random((2, 50)) < 0.7
            best.offer(np.array([2, 0]), s, ids, mask)
            for line, who in zip((2, 0), range(2), strict=True):
                seen[line] += [(-int(s[who, j]), int(ids[j])) for j in range(50) if mask[who, j]]
        i, got, who = best.lists()
        for line in (0, 1, 2):
            assert [(-int(s), int(w)) for k, s, w in zip(i, got, who, strict=True) if k == line] == sorted(seen[line])[:4]


def test_products_are_exact():
    big = np.array([[2**30, -(2**30) + 1, 3]], np.int64)
    assert integers.dot(big, big)[0, 0] == sum(int(c) ** 2 for c in big[0])
    x = np.array([[-(2**40), 5]], np.int64)
    assert (integers.unpacked(integers.packed(x), 1, 2) == x).all()


@pytest.mark.parametrize("chunk", [5, 12, 64])
def test_hard_negatives(spark, vectors, chunk, monkeypatch):
    monkeypatch.setattr(negatives, "STRETCH", 1)
    got = Counter(map(tuple, negatives.mine(table(spark, vectors), F.col("vec_id") % 10 == 0, 3, 2, (60, 105), chunk=chunk).collect()))
    rows, want = usable(vectors, True), Counter()
    for a, (i, label, x) in enumerate(rows):
        if i % 10:
            continue
        others = [(-score(x, y), j, m) for b, (j, m, y) in enumerate(rows) if b != a and len(x) == len(y)]
        for p, j, _ in sorted(o for o in others if o[2] == label)[:3]:
            fits = sorted((s, n) for s, n, m in others if m != label and 60 * -p <= 100 * -s <= 105 * -p)[:2]
            want.update((i, j, k + 1, n, -p, -s) for k, (s, n) in enumerate(fits))
    assert got == want
    assert negatives.mine(table(spark, vectors[:3]).limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_partial_tiles_are_summed(spark, vectors, monkeypatch):
    seen = []
    tiles = negatives._tiles
    monkeypatch.setattr(negatives, "_tiles", lambda *a: (seen.append(tiles(*a)), seen[-1])[1])
    negatives.mine(table(spark, vectors), F.col("vec_id") % 10 == 0, chunk=4).collect()
    counts = seen[0].groupBy("dim", "a", "seq").count().where("dim = 12").select("count").distinct().collect()
    assert [r[0] for r in counts] == [3]


WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows, least, most):
    """The contract of the audit, word by word, in Python's integers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    n, docs = Counter(), Counter()
    for text, lang, source in rows:
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text)]
        n.update((lang, source, w) for w in words)
        docs.update((lang, w) for w in set(words))
    out = set()
    for lang in {r[1] for r in rows}:
        terms = [w for (la, w), d in docs.items() if la == lang and d >= least]
        sources = sorted({r[2] for r in rows if r[1] == lang})
        p = {}
        for s in [*sources, None]:
            c = {w: sum(n[lang, x, w] for x in (sources if s is None else [s])) for w in terms}
            below = sum(c.values()) + 5 * len(terms)
            p[s] = {w: 1 + 10**9 * (c[w] + 5) // below for w in terms}
        for s in sources:
            apart = [(-sum(abs(p[s][w] - p[o][w]) for w in terms), o.encode(), o) for o in sources if o != s]
            above = [(p[None][w] - p[s][w], w.encode(), w) for w in terms if n[lang, s, w] and p[s][w] > p[None][w]]
            for part, found in (("pair", sorted(apart)), ("term", sorted(above)[:most])):
                out |= {(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)}
    return out


def corpus():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeéÑ語'Z") for _ in range(r.randint(1, 4))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocab[: r.choice([10, 100, 300])]) + r.choice(["", ".", "9x"]) for _ in range(n))
    rows = [(text(r.randint(0, 60)), r.choice(["en", "en", "en", "fr"]), f"s{min(r.randrange(30), 9)}") for _ in range(400)]
    rows += [(None, "en", "mute"), ("", None, None), ("12 34", "de", "x"), ("12", "de", "y"), (text(20_000), "fr", None), ("hot " * 3000, "en", "s9"), ("é" * 5000, "xx", "only")]
    return rows + rows[:40] * 3


@pytest.mark.parametrize(("groups", "block"), [(128, 512), (3, 7)])
def test_divergence(spark, groups, block, monkeypatch):
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "STRETCH", 2)
    monkeypatch.setattr(divergence, "HELD", 40_000)
    monkeypatch.setattr(divergence, "TOGETHER", 2)  # counts of three files meet in two steps
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2, "t", 3) for r in rows], "text string, lang string, source string, n int, hash int, term string, block int").repartition(3)
    got = [tuple(r) for r in divergence.audit(docs, 12, 7).collect()]
    want = audited(rows, 12, 7)
    assert len(got) == len(set(got)) and set(got) == want
    assert {(r[3], r[4]) for r in got if r[:3] == ("de", "x", "pair")} == {("y", 0)}
    assert divergence.audit(docs.limit(0)).count() == 0


def test_long_division_is_exact():
    counts, total = np.array([0, 7, 9 * 10**14], np.int64), np.array([9 * 10**14 + 7] * 3, np.int64)
    assert divergence.scaled(counts, total, 3).tolist() == [1 + 10**9 * (int(c) + 5) // (int(n) + 15) for c, n in zip(counts, total, strict=True)]
