"""Perspective views, picks and culled leaves; defaults that follow the spacing; shapes as a command; opening by shift and by cache."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import matrix as M
from pointloom.operators import layout as L
from pointloom.operators import raster as R
from pointloom.session import Session
from pointloom.sources import files

CAMERA = {"width": 64, "height": 48, "eye": (0.3, -9.0, 2.0), "target": (0.0, 0.0, 0.0), "up": (0.0, 0.0, 1.0), "fov": 50.0}
POINT = "gid long, x double, y double, z double"


def brute(points: np.ndarray, camera: dict) -> dict:
    """The nearest point of each pixel, by a camera's axes."""
    eye, target, up = (np.array(camera[k]) for k in ("eye", "target", "up"))
    a = (target - eye) / np.linalg.norm(target - eye)
    r = np.cross(a, up) / np.linalg.norm(np.cross(a, up))
    u, tall, best = np.cross(r, a), np.tan(np.radians(camera["fov"]) / 2), {}
    for gid, p in enumerate(points):
        depth = (p - eye) @ a
        if not 0.01 <= depth <= camera.get("far", np.inf):
            continue
        half = camera["height"] / 2
        px = int(np.floor(camera["width"] / 2 + half * ((p - eye) @ r) / depth / tall))
        py = camera["height"] - 1 - int(np.floor(half + half * ((p - eye) @ u) / depth / tall))
        if 0 <= px < camera["width"] and 0 <= py < camera["height"]:
            best[px, py] = min(best.get((px, py), (np.inf, 0)), (depth, gid))
    return {k: g for k, (_, g) in best.items()}


@pytest.fixture(scope="module")
def scattered(spark):
    at = np.random.default_rng(3).normal(0, 4, (3000, 3))
    return at, spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(at)], POINT)


@pytest.mark.parametrize("far", [None, 11.0])
def test_perspective_view_is_the_nearest_point_of_each_pixel(spark, scattered, far):
    at, cloud = scattered
    camera = CAMERA | ({"far": far} if far else {})
    view = M.perspective(**camera)
    got = {(r.px, r.py): r.gid for r in R.perspective_view(cloud, view, 64, 48).collect()}
    assert got == brute(at, camera) and len(got) > 300
    for px, py in list(got)[:3]:
        assert R.pick(cloud, px, py, view, 64, 48).first().gid == got[px, py]


def test_view_of_odd_points(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, nan, 0.0, 0.0), (1, inf, 0.0, 0.0), (2, None, 0.0, 0.0), (3, 0.0, -20.0, 0.0), (4, 0.0, 0.0, 0.0), (5, 0.0, 0.0, 0.0), (6, 0.0, -inf, nan)]
    cloud, view = spark.createDataFrame(rows, POINT), M.perspective(**CAMERA)
    assert [r.gid for r in R.perspective_view(cloud, view, 64, 48).collect()] == [4]  # ties go to the least gid
    empty = cloud.limit(0)
    assert R.perspective_view(empty, view, 64, 48).count() == 0 and R.pick(empty, 3, 3, view, 64, 48).first() is None
    assert R.pick(cloud, 0, 0, view, 64, 48, 2).first() is None
    with pytest.raises(ValueError):
        M.perspective(64, 48, (0, 0, 0), (0, 0, 1), (0, 0, 1), 50.0)


def test_the_far_side_reaches_the_scan(spark, scattered, tmp_path):
    scattered[1].write.parquet(f"{tmp_path}/c")
    table = R.perspective_view(spark.read.parquet(f"{tmp_path}/c"), M.perspective(**CAMERA, far=11.0), 64, 48)
    pushed = next(line for line in table._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n") if "PushedFilters" in line)
    assert all(f"{side}ThanOrEqual({c}," in pushed for side in ("Greater", "Less") for c in "xyz")


def test_no_leaf_with_a_shown_point_is_culled(spark, scattered):
    cloud = scattered[1]
    view, leaved = M.perspective(**CAMERA), L.with_leaf(cloud, 1.5)
    leaves = L.leaf_bounds(leaved, 1.5)
    seen = R.leaves_seen(leaves, view)
    assert seen.count() < leaves.count() * 0.8
    whole = {(r.px, r.py, r.gid) for r in R.perspective_view(cloud, view, 64, 48).collect()}
    assert {(r.px, r.py, r.gid) for r in R.perspective_view(leaved.join(seen, "leaf", "left_semi"), view, 64, 48).collect()} == whole


def grid(spark, step: float, n: int = 40):
    return spark.range(n * n).select(F.col("id").alias("gid"), (F.col("id") % n * step).alias("x"), (F.floor(F.col("id") / n) * step).alias("y"), F.lit(0.0).alias("z"))


@pytest.mark.parametrize("step", [0.01, 20.0])
def test_defaults_follow_the_spacing(spark, step):
    s = Session(spark)
    s.add("a", grid(spark, step).withColumn("z", F.when(F.col("gid") == 5, 9 * step).otherwise(0.0)))
    assert s.layer.spacing() == pytest.approx(step, rel=0.1)
    assert s.run("analysis", op="sor", neighbours=6, nSigma=3.0)["points"] == 1599
    s.run("analysis", op="components")
    assert s.layer.cloud.agg(F.count_distinct("component")).first()[0] == 1
    got = s.run("section", axis="x")
    assert got["thickness"] == pytest.approx(max(0.1, 8 * s.layer.spacing())) and got["at"] == pytest.approx(19.5 * step)
    s.run("regions", op="place", at=[0, 0, 0], size="spacing", id="r")
    assert s.regions["r"].radius == pytest.approx(max(0.25, 6 * s.layer.spacing(), 0.02 * 39 * step) / 2)
    got = s.run("contour", z=0.0)
    assert len(got["lines"]) == 1 and got["cell"] >= 2.5 * s.layer.spacing() * 0.999


def test_spacing_is_of_the_placed_version(spark):
    s = Session(spark)
    s.add("a", grid(spark, 1.0))
    one = s.layer.spacing()
    s.run("transform", op="scale", factor=3.0)
    assert s.layer.spacing() == pytest.approx(3 * one)
    s.run("analysis", op="subsample", spacing=12.0)
    assert s.layer.spacing() > 6 * one
    s.run("history", op="undo")
    assert s.layer.spacing() == pytest.approx(3 * one)
    assert L.cloud_spacing(s.layer.cloud.limit(0)) == L.cloud_spacing(s.layer.cloud.limit(1)) == 0.05


def test_view_and_pick_commands(spark, scattered):
    s = Session(spark)
    s.add("a", scattered[1])
    got = s.run("view", camera=CAMERA, name="front")
    assert got["pixels"] == s.views["front"].count() and np.allclose(np.reshape(got["viewProjection"], (4, 4)), M.perspective(**CAMERA))
    pixel = s.views["front"].orderBy("py", "px").first()
    hit = s.run("pick", px=pixel.px, py=pixel.py, camera=CAMERA)
    assert hit["hit"] and hit["gid"] == pixel.gid and hit["depth"] == pytest.approx(pixel.depth)
    assert s.run("view", perPixel=1.0)["pixels"] == s.views["view"].count()


def test_shapes_command(spark):
    floor = grid(spark, 0.1)
    s = Session(spark)
    s.add("a", floor.unionByName(floor.limit(50).withColumns({"gid": F.col("gid") + 5000, "z": 3.0 + F.sin("gid")})))
    with pytest.raises(ValueError):
        s.run("shapes", op="keep")
    assert [f["kind"] for f in s.run("detect", tolerance=0.02, minPoints=1000, shapes=["plane"])["shapes"]] == ["plane"]
    assert s.run("shapes", op="label")["points"] == 1650
    assert s.run("shapes", op="keep")["points"] == 1600
    s.run("history", op="undo")
    assert s.run("shapes", op="remove")["points"] == 50
    quiet = Session(spark, allow_edits=False)
    quiet.add("a", floor)
    assert quiet.run("shapes") == {"shapes": []}
    with pytest.raises(PermissionError):
        quiet.run("shapes", op="keep")


def test_layers_are_placed_by_their_shifts_and_kept_by_their_keys(spark, tmp_path):
    for name, x in (("a", 500_000.0), ("b", 500_020.0)):
        files.write_las(grid(spark, 0.5, 20).withColumn("x", F.col("x") + x), f"{tmp_path}/{name}.las")
    shifts = [np.array(files.shift_of(f"{tmp_path}/{n}.las")) for n in "ab"]
    s = Session(spark)
    for n in "ab":
        s.run("open", path=f"{tmp_path}/{n}.las", local=True)
    frame = np.array(s.frame)
    assert np.allclose(frame, shifts[0]) and np.allclose(s.layers["b.las"].matrix[:3, 3], shifts[1] - shifts[0])
    for n, x in (("a", 500_000.0), ("b", 500_020.0)):
        assert s.layers[f"{n}.las"].placed().agg(F.min("x")).first()[0] + frame[0] == pytest.approx(x, abs=1e-2)
    first = s.run("open", path=f"{tmp_path}/a.las", name="c", stride=2, cache=f"{tmp_path}/kept")
    again = s.run("open", path=f"{tmp_path}/a.las", name="d", stride=2, cache=f"{tmp_path}/kept")
    other = s.run("open", path=f"{tmp_path}/a.las", name="e", stride=4, cache=f"{tmp_path}/kept")
    assert (first["cached"], again["cached"], other["cached"]) == (False, True, False) and first["key"] == again["key"] != other["key"]
    assert s.layers["d"].cloud.count() == 200 and s.layers["e"].cloud.count() == 100
