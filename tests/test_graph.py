"""Duplicates, components and orientation over many small tiles, against plain versions, and how many rounds they take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import graph as G
from pointloom.operators import tiles as T
from pointloom.plans import stars
from test_tiles import squared, table


@pytest.fixture(params=[20, 16_384])
def tile_points(request, monkeypatch):
    monkeypatch.setattr(T, "TILE_POINTS", request.param)
    return request.param


@pytest.fixture
def rounds(monkeypatch):
    counted = []
    for module, name in ((stars, "_marked"), (stars, "_signed"), (G, "_by_tile")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *x, real=real: counted.append(1) or real(*x))
    return counted


def greedy(at, ids, tolerance):
    keep, d2 = {}, squared(at, at)
    for k in np.argsort(ids, kind="stable"):
        keep[ids[k]] = not any(keep.get(ids[j]) for j in np.flatnonzero(d2[k] <= tolerance * tolerance) if j != k)
    return {int(i): int(v) for i, v in keep.items()}


def test_duplicates(spark, tile_points):
    rng = np.random.default_rng(2)
    at = np.concatenate([rng.random((350, 3)) * [1, 1, 0.05], np.repeat(rng.random((3, 3)), 30, axis=0), np.linspace([0, 2, 0], [3, 2, 0], 80)])
    ids = rng.permutation(len(at)) * 3
    got = {r.gid: r.keep for r in G.duplicates(table(spark, at, ids), 0.06).collect()}
    assert got == greedy(at, ids, 0.06)
    rows = table(spark, at[:2]).unionAll(spark.createDataFrame([(90, None, 0.0, 0.0), (91, float("nan"), 0.0, 0.0)], "gid long, x double, y double, z double"))
    assert {r.gid: r.keep for r in G.duplicates(rows, 1e-9).collect()} == {0: 1, 1: 1, 90: 1, 91: 1}
    assert G.duplicates(rows.where("false")).count() == 0


def test_duplicates_along_a_line(spark, rounds, monkeypatch):
    monkeypatch.setattr(T, "TILE_POINTS", 1000)
    line = spark.range(10_000).select(F.col("id").alias("gid"), (F.col("id") * 0.001).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    got = G.duplicates(line, 0.0015)
    assert got.where("keep = 1").agg(F.count("*"), F.max(F.col("gid") % 2)).first()[:] == (5000, 0)
    assert len(rounds) < 20


def test_components(spark, tile_points):
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.random((200, 3)) * 0.4, rng.random((90, 3)) * 0.3 + 5, np.linspace([9, 0, 0], [9, 6, 0], 120), rng.random((6, 3)) * 300])
    near = squared(at, at) <= 0.15 * 0.15
    root = np.arange(len(at))
    for _ in range(len(at)):
        after = np.where(near, root[None], len(at)).min(axis=1)
        if (after == root).all():
            break
        root = after
    kept = sorted(((np.sum(root == r), -r) for r in set(root.tolist()) if np.sum(root == r) >= 5), reverse=True)
    label = {-r: k for k, (_, r) in enumerate(kept)}
    got = {r.gid: r.label for r in G.components(table(spark, at), 0.15, 5).collect()}
    assert got == {i: label.get(int(root[i])) for i in range(len(at))} and len(kept) == 3


def strip(spark, n):
    """A long wavy strip whose normals point either way by a hash."""
    t = F.col("id") * 0.01
    rows = spark.range(n).select(F.col("id").alias("gid"), t.alias("x"), F.sin(t * 0.2).alias("y"), (F.pmod(F.col("id") * 7, F.lit(5)) * 0.004).alias("z"))
    slope = F.cos(F.col("x") * 0.2) * 0.2
    size = F.sqrt(1 + slope * slope)
    s = F.when(F.pmod(F.xxhash64("gid"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return rows.select("gid", "x", "y", "z", (-slope / size * s).alias("nx"), (s / size).alias("ny"), F.lit(0.0).alias("nz"))


def test_orientation_of_a_long_strip(spark, rounds, monkeypatch):
    monkeypatch.setattr(T, "TILE_POINTS", 2000)
    out = G.orient(strip(spark, 100_000), 6)
    assert out.agg(F.count("*"), F.abs(F.sum(F.signum("ny")))).first()[:] == (100_000, 100_000)
    assert len(rounds) < 30


def test_orientation_votes_by_component(spark, tile_points):
    rng = np.random.default_rng(12)
    ball = rng.standard_normal((500, 3))
    ball /= np.linalg.norm(ball, axis=1, keepdims=True)
    both = np.concatenate([ball, ball + [30, 0, 0]])  # the second is seen from the middle between: most of it looks away all the same
    flip = rng.choice([-1.0, 1.0], (1000, 1))
    n = np.concatenate([ball, ball]) * flip
    rows = [(i, *map(float, p), *map(float, v)) for i, (p, v) in enumerate(zip(both, n, strict=True))] + [(2000, 0.0, 0.0, 9.0, None, None, None)]
    cloud = spark.createDataFrame(rows, "gid long, x double, y double, z double, nx double, ny double, nz double")
    got = {r.gid: r for r in G.orient(cloud, 6).collect()}
    assert len(got) == 1001 and got[2000].nx is None
    for part in (range(500), range(500, 1000)):
        sides = {np.sign(np.dot((got[i].nx, got[i].ny, got[i].nz), ball[i % 500])) for i in part}
        assert len(sides) == 1
    seen = {r.gid: r for r in G.orient(cloud.where("gid < 500"), 6, viewpoint=(0.0, 0.0, 0.0)).collect()}
    assert all(np.dot((seen[i].nx, seen[i].ny, seen[i].nz), ball[i]) < 0 for i in range(500))  # toward the middle


def test_signed_components(spark):
    rng = np.random.default_rng(5)
    truth = rng.choice([-1, 1], 400)
    links = [(int(a), int(b), float(truth[a] * truth[b])) for a, b in rng.integers(0, 300, (500, 2))] + [(k, k + 1, float(truth[k] * truth[k + 1])) for k in range(300, 399)]
    got = {r.node: r for r in stars.signed_components(spark.createDataFrame(links, "a long, b long, weight double")).collect()}
    plain = {r.node: r.component for r in stars.components(spark.createDataFrame(links, "a long, b long, weight double")).collect()}
    assert {k: r.component for k, r in got.items()} == plain
    assert all(r.sign == truth[k] * truth[r.component] for k, r in got.items())
    one = stars.signed_components(spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (1, 3, -0.1)], "a long, b long, weight double")).collect()
    assert {(r.node, r.component, r.sign) for r in one} == {(1, 1, 1), (2, 1, 1), (3, 1, 1)}  # the weak link gives way


def walked(n, i, j, weight):
    """The forest by a walk over the edges, strongest first."""
    order, root, sign = np.lexsort((np.maximum(i, j), np.minimum(i, j), -np.abs(weight))), np.arange(n), np.ones(n, int)
    for e in order:
        a, b = sorted((root[i[e]], root[j[e]]))
        if a != b:
            turn = sign[i[e]] * sign[j[e]] * (-1 if weight[e] < 0 else 1)
            moved = root == b
            root[moved], sign[moved] = a, sign[moved] * turn
    return root, sign


def test_strongest_forest():
    rng = np.random.default_rng(8)
    for n, m in ((1, 0), (60, 30), (300, 900), (300, 4000)):
        i, j = rng.integers(0, n, (2, m))
        i, j, weight = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(np.round(rng.uniform(-1, 1, m), 1), 2)
        for got, right in zip(G.strongest(n, i, j, weight), walked(n, i, j, weight), strict=True):
            assert (got == right).all()


def test_orientation_joins_no_neighbours(spark, monkeypatch):
    """What a neighbour's normal says is known where the neighbour is found: joins see only what crosses tiles, never all pairs."""
    monkeypatch.setattr(T, "TILE_POINTS", 2000)
    rows, real = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: rows.append(real(df)) or rows[-1])
    out = G.orient(strip(spark, 20_000), 6)
    assert out.count() == 20_000 and all(r.count() <= 20_000 for r in rows)
