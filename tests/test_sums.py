"""Sums that neither the order of rows nor the number of tasks has a say in."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import columns as C
from pointloom.operators import features as FE
from pointloom.operators import mesh as ME
from pointloom.operators import tiles as T
from pointloom.plans.prefix import running_total


@pytest.fixture(scope="module")
def values():
    draw = random.Random(5)
    return [(k, draw.choice([1e9, 1.0, 1e-9, -1e9]) * draw.random()) for k in range(6000)]


def test_sum_is_the_same_in_any_order(spark, values):
    from math import fsum

    rows, seen = list(values), set()
    for k in range(4):
        random.Random(k).shuffle(rows)
        seen.add(spark.createDataFrame(rows, "id long, v double").repartition(k + 1).agg(C.true_sum(F.col("v")).alias("s")).first().s)
    assert len(seen) == 1 and seen.pop() == pytest.approx(fsum(v for _, v in values), rel=1e-15)
    odd = spark.createDataFrame([(1.5, "a"), (None, "a"), (1e300, "b"), (1.0, "b"), (float("nan"), "c"), (None, "d")], "v double, k string")
    got = {r.k: r.s for r in odd.groupBy("k").agg(C.true_sum(F.col("v")).alias("s")).collect()}
    assert got["a"] == 1.5 and got["b"] == 1e300 and got["c"] != got["c"] and got["d"] is None


def test_running_total_does_not_drift(spark, values):
    from fractions import Fraction

    rows = spark.createDataFrame([(k, abs(v)) for k, v in values], "id long, v double")
    got = [r.t for r in running_total(rows, "id", "v", "t", 64).orderBy("id").collect()]
    whole, want = Fraction(0), []
    for _, v in values:
        whole += Fraction(abs(v))
        want.append(float(whole))
    assert got == pytest.approx(want, rel=4e-16, abs=1e-14)
    assert got == [r.t for r in running_total(rows, "id", "v", "t", 1000).orderBy("id").collect()]


def test_measures_are_the_same_in_any_order(spark):
    from pointloom.plans.catalogue import blocks

    v, t = blocks(spark, "/root/testdata/sf0.01")
    assert len({tuple(ME.measure(v.repartition(n), t.repartition(n)).select("area", "volume").first()) for n in (1, 3, 7)}) == 1


def test_a_mesh_out_of_an_explode_is_not_broadcast(spark):
    from pointloom.plans.catalogue import blocks

    plan = ME.corners(*blocks(spark, "/root/testdata/sf0.01"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 3


@pytest.mark.parametrize("count", [1, 50, 5000, 150_000])
def test_sample_has_every_place_once(spark, count):
    """A triangle of almost all the area, many small ones, one of none and one without a place."""
    v = [(0, 0.0, 0.0, 0.0), (1, 1000.0, 0.0, 0.0), (2, 0.0, 1000.0, 0.0), (3, 0.1, 0.0, 0.0), (4, 0.0, 0.1, 0.0), (5, float("nan"), 0.0, 0.0)]
    t = [(k, 0, 3, 4) for k in range(3000)] + [(5000, 0, 1, 2), (5001, 0, 0, 1), (5002, 0, 1, 5)]
    mesh = spark.createDataFrame(v, "vid long, x double, y double, z double"), spark.createDataFrame(t, "tid long, a long, b long, c long")
    got = ME.sample(*mesh, count).agg(F.count("*").alias("n"), F.count_distinct("gid").alias("ids"), F.min("gid").alias("least"), F.max("gid").alias("most"), F.avg("x").alias("x")).first()
    assert (got.n, got.ids, got.least, got.most) == (count, count, 0, count - 1)
    assert count < 5000 or abs(got.x - 1000 / 3) < 10
    assert ME.sample(*mesh, 0).count() == 0


def test_noise_adds_up_in_tiles(spark, monkeypatch):
    """Crowded neighbourhoods are added up where they are found: no row for each pair leaves a tile, and verdicts are those of all pairs."""
    rng = np.random.default_rng(3)
    at = np.concatenate([rng.normal(0, 0.1, (400, 3)), np.repeat(rng.random((2, 3)) + 4, 5, axis=0), rng.random((3, 3)) * 50 + 20])
    cloud = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "gid long, x double, y double, z double")
    right = {}
    for i, p in enumerate(at):
        near = np.flatnonzero(((at - p) ** 2).sum(axis=1) <= 0.0064)
        d = at[near[near != i]] - p
        if len(near) <= 3:
            right[i] = 1
            continue
        _, v = np.linalg.eigh(np.cov(d.T, bias=True))
        right[i] = int(abs(d.mean(axis=0) @ v[:, 0]) <= 0.02)
    monkeypatch.setattr(FE, "radius_join", None)
    for points in (16_384, 50):
        monkeypatch.setattr(T, "TILE_POINTS", points)
        assert {r.gid: r.keep for r in FE.noise(cloud, 1.0, 0.08, absolute=0.02).collect()} == right
