"""Searches over tiles against brute force, with many small tiles: outliers, ties, other clouds, any reach, triangles."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import neighbours as N
from pointloom.operators import tiles as T


def table(spark, at, ids=None):
    ids = range(len(at)) if ids is None else ids
    return spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(ids, at, strict=True)], "gid long, x double, y double, z double")


@pytest.fixture(scope="module")
def uneven():
    """A dense ball, a thin sheet, places taken by many, and far outliers."""
    rng = np.random.default_rng(3)
    ball, sheet = rng.standard_normal((500, 3)) * 0.02, rng.random((400, 3)) * [5, 5, 0.001]
    same = np.repeat([[1.0, 1.0, 1.0], [2.0, 2.0, 2.0]], 20, axis=0)
    grid = np.stack(np.meshgrid(*[np.arange(5.0)] * 3), axis=-1).reshape(-1, 3) + 7
    return np.concatenate([ball, sheet, same, grid, [[1e4, 0, 0], [-1e5, 3, 3], [0, 0, 2e6]]])


def squared(a, b):
    d = b[None] - a[:, None]
    return d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]


def expected(a, b, k, reach=np.inf):
    out = []
    for i, row in enumerate(squared(a, b)):
        order = np.lexsort((np.arange(len(b)), row))[:k]
        out += [(i, int(j), float(row[j]), r) for r, j in enumerate(order, 1) if row[j] <= reach * reach]
    return sorted(out)


@pytest.fixture(params=[16, 16_384])
def tile_points(request, monkeypatch):
    monkeypatch.setattr(T, "TILE_POINTS", request.param)
    return request.param


@pytest.mark.parametrize("reach", [None, 0.05, 1e9])
def test_nearest(spark, uneven, tile_points, reach):
    got = N.nearest(table(spark, uneven).repartition(3), 7, reach=reach).collect()
    assert sorted((r.gid, r.nb, r.d2, r["rank"]) for r in got) == expected(uneven, uneven, 7, np.inf if reach is None else reach)


def test_nearest_of_another_cloud(spark, uneven, tile_points):
    asking = np.random.default_rng(5).standard_normal((200, 3)) * [3, 3, 30]
    for k, reach in ((1, 0.5), (3, None), (2000, None)):  # more than there are: all of them
        got = N.nearest(table(spark, asking), k, None, table(spark, uneven), reach).collect()
        assert sorted((r.gid, r.nb, r.d2, r["rank"]) for r in got) == expected(asking, uneven, k, reach or np.inf)
    none = N.nearest_one(table(spark, asking[:5]), table(spark, uneven).where("false"), 1.0).collect()
    assert len(none) == 5 and all(r.nb is None for r in none)


def test_within(spark, uneven, tile_points):
    got = N.radius_join(table(spark, uneven), 0.03).collect()
    d2 = squared(uneven, uneven)
    assert sorted((r.gid, r.nb, r.d2) for r in got) == sorted((int(i), int(j), float(d2[i, j])) for i, j in zip(*np.nonzero(d2 <= 0.03 * 0.03), strict=True))


def test_rows_without_a_place_are_near_nothing(spark, tile_points):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, 1.0, 0.0, 0.0)], "gid long, x double, y double, z double")
    assert sorted((r.gid, r.nb) for r in N.nearest(rows, 3).collect()) == [(1, 1), (1, 4), (4, 1), (4, 4)]


def test_triangles(spark, tile_points):
    rng = np.random.default_rng(6)
    corners = rng.random((300, 1, 3)) * 4 + rng.standard_normal((300, 3, 3)) * 0.3
    corners[0] = corners[0, :1]  # a triangle that is a point
    corners[1, 2] = corners[1, 0] * 2 - corners[1, 1]  # one that is a line
    corners[2] = [[-50, -50, 9], [50, -50, 9], [0, 80, 9]]  # one far wider than its tile
    vertices = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(corners.reshape(-1, 3))], "vid long, x double, y double, z double")
    triangles = spark.createDataFrame([(i, 3 * i, 3 * i + 1, 3 * i + 2) for i in range(300)], "tid long, a long, b long, c long")
    asking = rng.random((150, 3)) * 6 - 1
    mesh = T.Triangles(np.arange(300), corners.reshape(-1, 9))
    order = np.argsort(mesh.gid)
    d2, side = (x[:, order] for x in mesh.distances(asking, np.arange(300)))
    plain = np.full((150, 300), np.inf)  # the triangles by many of their places
    for u, v in [(u, v) for u in np.linspace(0, 1, 21) for v in np.linspace(0, 1 - u, 21)]:
        plain = np.minimum(plain, squared(asking, corners[:, 0] * (1 - u - v) + corners[:, 1] * u + corners[:, 2] * v))
    close = plain.min(axis=1) < 1
    assert (d2 <= plain + 1e-12).all() and np.abs(np.sqrt(d2.min(axis=1)) - np.sqrt(plain.min(axis=1)))[close].max() < 0.05
    for reach in (0.4, 1e6):
        got = {r.gid: r.d for r in N.mesh_distance(table(spark, asking), vertices, triangles, reach, signed=True).collect()}
        for i in range(150):
            low = d2[i].min()
            assert got[i] is None if low > reach * reach else got[i] == pytest.approx(np.sqrt(low) * (-1 if side[i, d2[i].argmin()] < 0 else 1))


def test_copies_of_a_point_and_balance(spark, capsys):
    rng = np.random.default_rng(7)
    at = np.concatenate([rng.random((30_000, 3)), rng.random((30_000, 3)) * 0.01])  # half of the points in a millionth of the room
    tiled = T.Tiled(table(spark, at), points=4000)
    sizes = tiled.plan.n[2**tiled.plan.depth :]
    assert sizes.sum() == 60_000 and sizes.max() < 2 * 60_000 / len(sizes)
    asked = tiled.asked_within(table(spark, at), 0.0005).count()
    with capsys.disabled():
        print(f"\ncopies of an asking point within a radius of eight neighbours: {asked / 60_000:.2f}", end=" ")
    assert asked / 60_000 < 2


def test_cost_does_not_depend_on_the_reach(spark):
    at = np.random.default_rng(8).random((8000, 3))
    points, reference = table(spark, at[:4000]).cache(), table(spark, at[4000:]).cache()
    points.count(), reference.count()
    took = []
    for reach in (0.05, 0.05, 12.0):  # one spacing; 200 of them
        began = time.time()
        assert N.distance_to(points, reference, reach).where("d is not null").count() > 3000
        took.append(time.time() - began)
    assert took[2] < 3 * took[1] + 2
    assert N.distance_to(points, reference, 1e-9).agg(F.count("d")).first()[0] == 0
