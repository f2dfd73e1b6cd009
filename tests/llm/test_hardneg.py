"""Hard negatives against brute force: ties, copies, odd vectors, small blocks, bounds that stop early."""

import math
import random

import numpy as np
import pytest

from lautwerk.llm import hardneg as h

ROWS = "vec_id long, embedding array<double>, label int, cluster string, block string, anchor string, score string"


def brute(rows):
    use = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, v, label in {a[0]: a for a in use if a[0] % 50 == 0}.values():
        scored = sorted((-sum(map(lambda a, b: a * b, v, w)), j, other) for j, w, other in use if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            fit = [(s, k) for s, k, other in scored if other != label and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(i, j, n + 1, k, -p, -s) for n, (s, k) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], ROWS)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in h.mined(df).collect())


def clustered(n, d=8, seed=1, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    out = []
    for i in range(n):
        c = rng.integers(12)
        v = centres[c] + spread * rng.normal(size=d)
        out.append((i, (v / np.linalg.norm(v)).tolist(), int(c % 10)))
    return out


def test_clusters_against_brute_force(spark):
    rows = clustered(1500)
    assert mined(spark, rows) == brute(rows) != []


def test_copies_and_ties_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(h, "BLOCK", 16)
    monkeypatch.setattr(h, "QUERIES", 4)
    monkeypatch.setattr(h, "FIRST", 1)
    monkeypatch.setattr(h, "FACTOR", 2)
    rng = random.Random(3)
    few = clustered(25, d=3, seed=2, spread=0.5)
    rows = [(i, few[rng.randrange(3 if i % 3 else 25)][1], rng.randrange(3)) for i in range(700)]
    assert mined(spark, rows) == brute(rows) != []


def test_odd_rows(spark):
    rows = clustered(300)
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 1), (1050, [], 1), (1100, [nan] * 8, 1), (1150, [inf] * 8, 1), (1200, [None] * 8, 1), (1250, rows[0][1], None), (None, rows[0][1], 1), (1300, [0.0] * 8, 1)]
    rows += [(2000 + i, v[:5], label) for i, v, label in rows[:120]] + [(-i * 50, v, label) for i, v, label in rows[1:20]]
    rows += [(5000 + 50 * k, [-1e-20, 1.0, 1e6 * k] + [0.0] * 5, k % 2) for k in range(6)]
    assert mined(spark, rows) == brute(rows) != []
    assert mined(spark, []) == [] and mined(spark, rows[300:307]) == []


def test_scores_beyond_exact_doubles():
    x = np.array([[2.0**40, 3.0, -(2.0**30)]])
    assert h.products(x, x)[0, 0] == 2**63 - 1  # cut to 64 bits
    y = np.array([[2.0**10, 1.0, 0.0], [2.0**10, 0.0, 1.0]])
    assert h.products(x * 2, y).tolist() == [[2**51 + 6, 2**51 - 2**31]]


@pytest.mark.parametrize("k", [1, 3, 10, 50])
def test_leading_scores_with_ties(k):
    rng = np.random.default_rng(k)
    scores, fits = rng.integers(-5, 5, (30, 40)), rng.random((30, 40)) < 0.3
    for scale in (1, 2**55):
        i, j = h.leading(scores * scale, fits, k)
        for row in range(30):
            want = sorted(np.flatnonzero(fits[row]), key=lambda c: (-scores[row, c], c))[:k]
            assert sorted(j[i == row]) == sorted(want)


def test_far_clusters_are_not_visited(spark):
    """Bounds hold for every member, and a query of a tight cluster leaves the others out."""
    rows = np.array([v for _, v, _ in clustered(800, spread=0.02)])
    q = np.floor(rows * h.LEVELS)
    lists = h.Lists.fitted(q.tolist(), len(q), [8])
    own, far = lists.nearest(q)
    np.maximum.at(lists.radius, own, far)
    names, low, high = lists.bounds(q[:50])
    scores = q[:50] @ q.T
    assert (scores >= low[:, own]).all() and (scores <= high[:, own]).all()
    kth = np.sort(scores, axis=1)[:, -6]
    assert ((high >= kth[:, None]).mean(1) < 0.5).all()
