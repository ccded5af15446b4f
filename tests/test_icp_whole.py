"""A cloud larger than an ICP's sample is paired as a whole."""

import numpy as np

from pointloom.functions import matrix as M
from pointloom.operators import fitting as FI
from pointloom.operators import neighbours as N
from pointloom.operators import tiles as T


def _shell(spark, n, move=None):
    k = np.arange(n)
    z, turn = (k * 0.7548776662466927) % 1 * 2 - 1, (k * 0.5698402909980532) % 1 * 2 * np.pi
    unit = np.stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z], axis=1)
    at = unit * (2.0, 1.0, 0.5)
    at = at if move is None else at @ move[:3, :3].T + move[:3, 3]
    return spark.createDataFrame([(int(i), *map(float, p), *map(float, m)) for i, p, m in zip(k, at, unit, strict=True)], "gid long, x double, y double, z double, nx double, ny double, nz double")


def test_every_point_is_paired(spark):
    away = M.translation(0.05, -0.03, 0.02) @ M.rotation("z", 2.0)
    fixed, moved = _shell(spark, 20_000), _shell(spark, 20_000, away).select("gid", "x", "y", "z")
    found = FI.icp(moved, fixed, 0.3, sample=4000)
    assert found["pairs"] == 20_000 and found["overlap"] == 1.0 and found["rms"] < 1e-3
    assert np.abs(np.array(found["matrix"]).reshape(4, 4) @ away - np.eye(4)).max() < 5e-3


def test_rounds_ask_few_tiles(spark, monkeypatch):
    """However far the reach, a place asks the tiles about its nearest, and still finds that one."""
    monkeypatch.setattr(T, "TILE_POINTS", 40)
    asked, real = [], T.Plan.facing
    monkeypatch.setattr(T.Plan, "facing", lambda self, at, d2: asked.append(real(self, at, d2)) or asked[-1])
    fixed = _shell(spark, 5000)
    rows = np.array([tuple(r) for r in fixed.select("x", "y", "z").collect()])
    at = rows[::10] + (0.02, -0.01, 0.01)
    written = N.Written(fixed)
    away = np.sqrt(((at[:, None] - rows[None]) ** 2).sum(axis=2))
    for known, most in ((None, 16), (away.min(axis=1) * (1 + 1e-9), 3)):
        got = {r.gid: (r.nb, round(r.d2, 12)) for r in written.nearest(np.arange(500), at, 4.0, known).collect()}
        assert got == {k: (int(away[k].argmin()), round(float(away[k].min() ** 2), 12)) for k in range(500)}
        assert len(asked.pop()[0]) < most * 500
