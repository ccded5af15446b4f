"""Geometry with known answers, brute-force oracles on small clouds, and invariance to partitions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.functions import matrix as M
from pointloom.operators import features as FE
from pointloom.operators import fitting as FI
from pointloom.operators import graph as G
from pointloom.operators import layout as L
from pointloom.operators import mesh as ME
from pointloom.operators import neighbours as N
from pointloom.operators import raster as R
from pointloom.operators import regions as RG
from pointloom.plans.catalogue import _shell, cube, grid

XYZ = "gid long, x double, y double, z double"


def cloud(spark, points):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], XYZ)


@pytest.fixture(scope="module")
def scattered():
    random.seed(3)
    return [(random.random(), random.random(), random.random() * 0.2) for _ in range(220)] + [(5, 5, 5), (9, 9, 9)]


def test_nearest_is_exact_for_outliers_too(spark, scattered):
    p = np.array(scattered)
    got = {}
    for r in N.nearest(cloud(spark, scattered).repartition(5), 5, 0.1).collect():
        got.setdefault(r.gid, []).append((r.rank, r.nb))
    for i in range(len(p)):
        d = ((p - p[i]) ** 2).sum(1)
        assert [nb for _, nb in sorted(got[i])] == sorted(range(len(p)), key=lambda j: (d[j], j))[:5]


def test_sor_and_noise_against_brute_force(spark, scattered):
    p = np.array(scattered)
    d = np.sort(np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)), axis=1)[:, 1:8].mean(1)
    keep = d <= d.mean() + d.std()
    got = {r.gid: r.keep for r in FE.sor(cloud(spark, scattered), 8, 1.0, 0.1).collect()}
    assert [got[i] for i in range(len(p))] == keep.astype(int).tolist()
    got = {r.gid: r.keep for r in FE.noise(cloud(spark, scattered), 1.0, 0.25, drop_isolated=True).collect()}
    for i in range(len(p)):
        near = np.flatnonzero(((p - p[i]) ** 2).sum(1) <= 0.25**2)
        want = 0
        if len(near) > 3:
            q = p[near[near != i]]
            values, vectors = np.linalg.eigh(np.cov(q.T, bias=True))
            want = int(abs((p[i] - q.mean(0)) @ vectors[:, 0]) <= math.sqrt(max(values[0], 0)))
        assert got[i] == want


def test_features_of_plane_wall_and_line(spark):
    plane = [(i * 0.05, j * 0.05, 20.0) for i in range(14) for j in range(14)]
    row = FE.features(cloud(spark, plane), ("planarity", "linearity", "roughness", "curvature", "verticality"), 8, 0.1).agg(*[F.median(c).alias(c) for c in ("planarity", "linearity", "roughness", "curvature", "verticality")]).first()
    assert row.planarity > 0.9 and row.linearity < 0.1 and row.roughness < 0.002 and row.curvature < 0.01 and row.verticality < 0.06
    line = FE.feature(cloud(spark, [(k * 0.01, 0, 0) for k in range(60)]), "linearity", 8, cell=0.02).agg(F.median("value")).first()[0]
    assert line > 0.95


def test_duplicates_are_greedy_in_order(spark):
    random.seed(9)
    p = [(random.random(), random.random(), 0) for _ in range(150)]
    kept = []
    for i, a in enumerate(p):
        if all((a[0] - p[j][0]) ** 2 + (a[1] - p[j][1]) ** 2 > 0.06**2 for j in kept):
            kept.append(i)
    got = G.duplicates(cloud(spark, p), 0.06).where("keep = 1").collect()
    assert sorted(r.gid for r in got) == kept


def test_components_of_two_patches(spark):
    p = [(i * 0.1, j * 0.1, 0) for i in range(8) for j in range(8)] + [(50 + i * 0.1, j * 0.1, 0) for i in range(8) for j in range(7)] + [(99, 99, 99)]
    labels = [r.label for r in G.components(cloud(spark, p), 0.15, 10).orderBy("gid").collect()]
    assert labels == [0] * 64 + [1] * 56 + [None]


def test_thinning_does_not_depend_on_partitions(spark, scattered):
    want = sorted(r.gid for r in L.thin(cloud(spark, scattered).coalesce(1), 0.2).collect())
    assert sorted(r.gid for r in L.thin(cloud(spark, scattered).repartition(7), 0.2).collect()) == want


def test_regions_and_their_complements(spark, scattered):
    c = cloud(spark, scattered)
    for region in (RG.Region("sphere", (0.5, 0.5, 0.1), radius=0.3), RG.Region("box", (0.5, 0.5, 0.1), (0.3, 0.2, 0.1), quat=(0.92388, 0, 0, 0.382683))):
        inside, outside = RG.crop(c, region).count(), RG.crop(c, region, keep=False).count()
        assert inside + outside == len(scattered) and inside > 0
    ball = RG.crop(c, RG.Region("sphere", (0.5, 0.5, 0.1), radius=0.3)).count()
    assert ball == sum((x - 0.5) ** 2 + (y - 0.5) ** 2 + (z - 0.1) ** 2 <= 0.09 for x, y, z in scattered)
    fitted = RG.fit_to_contents(c, RG.Region("box", (0.5, 0.5, 0.1), (0.1, 0.1, 0.05)))
    assert RG.crop(c, fitted).count() == 220


def test_fits(spark):
    ball = FI.fit_sphere(_shell(spark, 400, 2.0).select("gid", (F.col("x") + 3).alias("x"), "y", "z"))
    assert ball["radius"] == pytest.approx(2.0, abs=1e-6) and ball["center"] == pytest.approx([3, 0, 0], abs=1e-6)
    pipe = spark.range(400).select(F.col("id").alias("gid"), F.cos("id").alias("nx"), F.sin("id").alias("ny"), F.lit(0.0).alias("nz"), (F.col("id") / 200).alias("z"))
    pipe = pipe.withColumns({"x": F.col("nx") * 0.15 + 1, "y": F.col("ny") * 0.15})
    found = FI.fit_cylinder(pipe)
    assert found["radius"] == pytest.approx(0.15, abs=1e-6) and abs(found["axis"][2]) == pytest.approx(1) and found["length"] == pytest.approx(1.995)
    plane = FI.fit_plane(cloud(spark, [(i, j, 0.5 * i) for i in range(8) for j in range(8)]))
    assert plane["dip"] == pytest.approx(math.degrees(math.atan(0.5))) and plane["rms"] < 1e-9
    circle = FI.fit_circle(spark.range(60).select(F.col("id").alias("gid"), F.cos("id").alias("x"), F.sin("id").alias("y"), F.lit(2.0).alias("z")))
    assert circle["radius"] == pytest.approx(1) and circle["center"] == pytest.approx([0, 0, 2], abs=1e-9)


def test_icp_undoes_a_small_move(spark):
    fixed = _shell(spark, 900).withColumns({"x": F.col("x") * 2, "z": F.col("z") * 0.5})
    fixed = fixed.withColumns({"nx": F.col("nx") / 2, "nz": F.col("nz") / 0.5})
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    fixed = fixed.withColumns({f"n{c}": F.col(f"n{c}") / size for c in "xyz"})
    moved = M.transform(fixed.select("gid", "x", "y", "z"), M.translation(0.05, -0.03, 0.02) @ M.rotation("z", 2.0))
    found = FI.icp(moved, fixed, 0.4)
    assert found["rms"] < 1e-3 and found["overlap"] > 0.99


def test_mesh_measure_smooth_sample_decimate(spark):
    m = ME.measure(*cube(spark)).first()
    assert (m.area, m.volume, m.closed, m.boundary_edges) == (pytest.approx(6), pytest.approx(1), True, 0)
    v, t = grid(spark, 6)
    assert ME.boundary(t).count() == 24
    flat = ME.smooth(v, t, 3).agg(F.max("z") - F.min("z")).first()[0]
    assert flat <= 1.0
    s = ME.sample(*cube(spark), 3000).agg(F.count("*"), F.avg("x"), F.min("z"), F.max("z")).first()
    assert abs(s[0] - 3000) < 20 and abs(s[1] - 0.5) < 0.03 and s[2] >= 0 and s[3] <= 1
    dv, dt = ME.decimate(v, t, 2.0)
    assert 0 < dv.count() < 49 and dt.count() < 72


def test_surface_of_a_sphere_closes(spark):
    m = ME.measure(*ME.build_surface(_shell(spark, 4000), 0.12)).first()
    assert m.closed and m.area == pytest.approx(4 * math.pi, rel=0.05) and m.volume == pytest.approx(4 / 3 * math.pi, rel=0.06)


def test_distance_to_a_cube(spark):
    v, t = cube(spark)
    points = [(0.5, 0.5, 3), (2, 2, 2), (0.5, 4, 4), (0.5, 0.5, 1), (0.5, 0.5, 0.5), (30, 0, 0)]
    got = {r.gid: r.d for r in N.mesh_distance(cloud(spark, points), v, t, 5.0).collect()}
    assert [got[k] for k in range(5)] == pytest.approx([2, math.sqrt(3), math.sqrt(18), 0, 0.5]) and got[5] is None


def test_volume_and_contour_of_a_pyramid(spark):
    n = 60
    table = spark.range((n + 1) ** 2).select((F.col("id") % (n + 1)).alias("u"), F.floor(F.col("id") / (n + 1)).alias("v"))
    table = table.withColumn("value", F.lit(3.0) - F.greatest(F.abs(F.col("u") - 30), F.abs(F.col("v") - 30)) * 0.1)
    row = R.volume(table, 0.1, plane=0.0).first()
    assert row.net == pytest.approx(36, rel=0.02) and row.removed == 0
    lines = R.stitch(R.contour_segments(table, [1.5])).collect()
    assert len(lines) == 1 and lines[0].closed
    xs = [p.x for p in lines[0].points]
    assert (max(xs) - min(xs)) * 0.1 == pytest.approx(3.0)
    assert len(R.simplify([(p.x, p.y) for p in lines[0].points], 0.4)) <= 9


def test_detect_finds_plane_and_ball(spark):
    from pointloom.plans.catalogue import detect

    assert [r.kind for r in detect(spark, "/root/testdata/sf0.001").orderBy("shape").collect()] == ["plane", "sphere"]


def test_detect_finds_a_small_ball_in_a_large_cloud(spark):
    """1.5% of the points, more than ``least``: too few in a draw of thousands to be proposed from it."""
    rng = np.random.default_rng(8)
    n, m = 200_000, 3000
    away = rng.standard_normal((m, 3))
    away /= np.linalg.norm(away, axis=1)[:, None]
    normals = rng.standard_normal((n, 3))
    p = np.vstack([rng.random((n, 3)) * 20, away * 0.5 + [7.3, 11.9, 4.2]])
    rows = np.column_stack([p, np.vstack([normals / np.linalg.norm(normals, axis=1)[:, None], away])])
    table = pd.DataFrame(rows, columns=["x", "y", "z", "nx", "ny", "nz"])
    table.insert(0, "gid", np.arange(n + m))
    found = FI.detect(spark.createDataFrame(table), least=2500)
    assert [s["kind"] for s in found] == ["sphere"] and found[0]["points"] >= m
    assert found[0]["radius"] == pytest.approx(0.5, abs=1e-3) and found[0]["center"] == pytest.approx([7.3, 11.9, 4.2], abs=1e-3)


def test_detect_over_many_tiles(spark, monkeypatch):
    """Two walls that cross, two balls and a pipe, with noise, over some thirty tiles: each is found whole, once."""
    from pointloom.operators import tiles

    monkeypatch.setattr(tiles, "TILE_POINTS", 2000)
    rng = np.random.default_rng(4)
    flat = lambda n: rng.random((n, 2)) * 8
    unit = rng.standard_normal((9000, 3))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    a, b, turn = flat(20_000), flat(15_000), rng.random(6000) * 2 * np.pi
    parts = [
        (np.column_stack([a, np.zeros(len(a))]), np.tile([0.0, 0, 1], (len(a), 1))), (np.column_stack([b[:, 0], np.full(len(b), 4.0), b[:, 1]]), np.tile([0.0, 1, 0], (len(b), 1))),
        (unit[:5000] * 0.7 + [2, 2, 2], unit[:5000]), (unit[5000:] * 0.4 + [6, 2, 5], unit[5000:]),
        (np.column_stack([np.cos(turn) * 0.3 + 6, np.sin(turn) * 0.3 + 6.5, rng.random(6000) * 6 + 1]), np.column_stack([np.cos(turn), np.sin(turn), turn * 0])), (rng.random((3000, 3)) * 8, unit[:3000]),
    ]
    rows = np.column_stack([np.vstack([p for p, _ in parts]) + rng.standard_normal((53_000, 3)) * 0.002, np.vstack([n for _, n in parts])])
    table = pd.DataFrame(rows, columns=["x", "y", "z", "nx", "ny", "nz"])
    table.insert(0, "gid", np.arange(len(table)))
    found = FI.detect(spark.createDataFrame(table), tolerance=0.02, least=2500)
    assert [(s["kind"], round(s["points"], -3)) for s in found] == [("plane", 20_000), ("plane", 15_000), ("cylinder", 6000), ("sphere", 5000), ("sphere", 4000)]
    assert [round(s["radius"], 2) for s in found[2:]] == [0.3, 0.7, 0.4]
