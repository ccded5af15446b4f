"""Hard negatives against brute force: one block and many, ties, repeats, odd vectors; the pruning bounds."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import hard_negatives as H
from pointloom.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, source string, rank int, block long"


def brute(rows, is_anchor, positives=5, negatives=3):
    good = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (a, q, own) in enumerate(good):
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, r, strict=False)), i, label) for j, (i, r, label) in enumerate(good) if j != k)
        for s, p, label in [x for x in scored if x[2] == own][:positives]:
            hard = [(t, n) for t, n, other in scored if other != own and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a, p, r, n, -s, -t) for r, (t, n) in enumerate(hard, 1)]
    return out


def found(spark, rows, anchor=lambda: F.col("vec_id") % 5 == 0):
    table = spark.createDataFrame([(i, v, label, "s", 1, 2) for i, v, label in rows], SCHEMA)
    return [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives(table, anchor()).collect()]


def cloud(rng, n, dim=6, labels=4):
    middles = rng.standard_normal((labels * 2, dim))
    return [(k, (middles[k % (labels * 2)] + rng.standard_normal(dim) * 0.4).tolist(), int(rng.integers(0, labels))) for k in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"CHUNK": 40, "BLOCK": 8, "ANCHORS": 8, "DEPTH": 3}])
def test_against_brute_force(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(H, k, v)
    rng = np.random.default_rng(4)
    rows = cloud(rng, 300)
    rows += [(1000 + k, rows[k % 3][1], k % 2) for k in range(30)]  # copies of a few, ties by id
    rows += [(500, rows[7][1], 1), (500, rows[7][1], 1), (505, [0.0] * 6, 2)]  # a repeated row, a zero vector
    rows += [(None, rows[0][1], 1), (2000, None, 1), (2001, [1.0, None], 1), (2005, [float("nan")] * 6, 1), (2010, [float("inf")] * 6, 0), (2015, rows[1][1], None), (2020, [], 1), (2025, [0.5, 1.5], 2), (2030, [0.7] * 40, 2)]
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 400 and sorted(found(spark, rows)) == sorted(want)


def test_no_rows_and_no_anchors(spark):
    rng = np.random.default_rng(1)
    assert found(spark, []) == [] and found(spark, [(k, v, 0) for k, v, _ in cloud(rng, 9)]) == []
    assert found(spark, cloud(rng, 9), lambda: F.lit(False)) == []
    assert found(spark, [(5, [1.0, 1.0], 1)]) == []  # no other row


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.random(5) * 1e6).tolist(), int(rng.integers(0, 2))) for k in range(40)]
    assert sorted(found(spark, rows)) == sorted(brute(rows, lambda i: i % 5 == 0))
    assert H.inner(np.array([[1e200, 1.0]]), np.array([[1e200, 0.0], [-1e200, 0.0], [0.0, 3.0]])).tolist() == [[2**63 - 1, -(2**63), 3]]


def test_intervals_hold_and_whole_groups_are_pruned():
    rng = np.random.default_rng(8)
    labels = np.zeros(1, np.int64)
    for _ in range(200):
        a, c = rng.standard_normal((9, 7)) * 50 + rng.standard_normal(7) * 200, rng.standard_normal((11, 7)) * 50 + rng.standard_normal(7) * 200
        low, high = H.interval(H._ball(a, labels), H._ball(c, labels))
        scores = a @ c.T
        assert low <= scores.min() and scores.max() <= high
    # Four far clusters: an anchor group that needs high scores meets its own cluster only, whatever stands elsewhere.
    middles = np.eye(4) * 1000
    balls = [H._ball(np.rint(middles[k // 8] + rng.standard_normal((20, 4))), labels) | {"name": k} for k in range(32)]
    asking = [b | {"least": 900_000.0, "most": float("inf"), "block": b["name"]} for b in balls[:8]]
    met = list(H.Tree(asking).meet(H.Tree(balls), True))
    assert {(a["block"], c["name"]) for a, c in met} == {(a, c) for a in range(8) for c in range(8)}
    tested = []
    original = H.needed
    try:
        H.needed = lambda *x: tested.append(1) or original(*x)
        list(H.Tree(asking).meet(H.Tree(balls), True))
    finally:
        H.needed = original
    assert len(tested) < 8 * 32 * 0.6  # of 256 pairs of blocks, 64 are scored and few nodes above are looked at
    assert defaultdict(int, {b["block"]: 1 for b, _ in met}).keys() == set(range(8))
