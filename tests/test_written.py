"""A reference that is written once: nearest with normals against brute force, over several tiles, and one shuffle of answers only."""

import numpy as np
import pytest

from pointloom.operators import neighbours as N
from pointloom.operators import tiles

NAMED = "gid long, x double, y double, z double, nx double, ny double, nz double"


@pytest.mark.parametrize("points", [64, 16_384])
def test_written_nearest_is_the_nearest(spark, monkeypatch, points):
    monkeypatch.setattr(tiles, "TILE_POINTS", points)
    rng = np.random.default_rng(2)
    at, normals = np.round(rng.normal(0, 1, (1500, 3)), 2), rng.normal(0, 1, (1500, 3))
    rows = [(k, *map(float, a), *map(float, n)) for k, (a, n) in enumerate(zip(at, normals, strict=True))]
    odd = [(9000, None, 0.0, 0.0, 0.0, 0.0, 1.0), (9001, float("nan"), 0.0, 0.0, 0.0, 0.0, 1.0), (9002, 0.0, 0.0, 0.0, None, None, None)]
    written = N.Written(spark.createDataFrame([*rows, *odd], NAMED), most=600)
    assert (written.plan.depth > 2) == (points == 64)
    asks = np.concatenate([np.round(rng.normal(0, 1.2, (500, 3)), 2), at[:50]])
    d2 = ((asks[:, None] - at[None]) ** 2).sum(axis=2)
    found = written.nearest(np.arange(550), asks, 0.4)
    got = {r.gid: r for r in found.collect()}
    assert set(got) == set(np.flatnonzero(d2.min(axis=1) <= 0.16).tolist()) and 100 < len(got) < 550
    for gid, r in got.items():
        best = int(d2[gid].argmin()) if d2[gid].min() > 1e-20 else int(np.flatnonzero(d2[gid] < 1e-20)[0])
        assert r.d2 == pytest.approx(d2[gid].min(), abs=1e-12)
        assert r.nb == best or d2[gid][r.nb] == pytest.approx(d2[gid][best], abs=1e-12)
        assert np.allclose((r.nx, r.ny, r.nz), normals[r.nb]) and np.allclose(np.add((r.x, r.y, r.z), (r.dx, r.dy, r.dz)), at[r.nb])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("MapInArrow")].count("Exchange") == 1 and "Exchange" not in plan[plan.index("MapInArrow") :].split("Initial Plan")[0]
    with pytest.raises(ValueError):
        written.nearest(np.arange(601), np.zeros((601, 3)), 0.4)


def test_nothing_asks_or_answers(spark):
    empty = N.Written(spark.createDataFrame([], NAMED))
    assert empty.nearest(np.arange(3), np.zeros((3, 3)), 1.0).count() == 0
    one = N.Written(spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], NAMED))
    assert one.nearest(np.zeros(0, np.int64), np.zeros((0, 3)), 1.0).count() == 0
