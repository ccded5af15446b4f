"""Screen regions, estimates, contours that end, density surfaces, caches, E57 fields and images, sessions, and queries beside their SQL."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pointloom.functions import columns as C
from pointloom.functions import matrix as M
from pointloom.operators import layout as L
from pointloom.operators import mesh as ME
from pointloom.operators import raster as R
from pointloom.operators import regions as RG
from pointloom.plans.catalogue import _shell, cube
from pointloom.session import Session
from pointloom.sources import e57, files

SMALL = "/root/testdata/sf0.001"
QUICK = [
    "f13_inside_box", "f1_prism", "f1_prism_many", "f2_keep_delete", "f8_lasso", "f9_prism_from_screen", "f7_shape_keep", "f7_shape_remove", "f11_estimate_kept", "f15_start_size",
    "f19_finite", "l1_octree", "l2_quantise", "l11_floor", "l11_headroom", "n12_prune", "s20_preview", "j1_transform", "j2_rotate_normals", "j4_colour_modes", "j4_more_modes",
    "j6_tone", "j17_dip", "n6_faced", "a6_exact_sum", "a11_raster_axis_x", "a15_robust_y", "v3_probe", "v1_perspective", "v1_leaves_seen", "v3_pick", "a30_tsdf_table", "u2_clone", "w3_cumulative_area",
]


def norm(v):
    return f"{v:.10g}" if isinstance(v, float) and v == v else None if v is None or isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db():
    import duckdb

    db = duckdb.connect()
    for name in ("orders", "events", "embeddings", "lineitem"):
        db.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", QUICK)
def test_query_is_what_its_sql_says(spark, db, name):
    got, want = entry.queries()[name](spark, SMALL), db.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted((tuple(map(norm, r)) for r in got.select(*columns).collect()), key=repr) == sorted((tuple(norm(r[k]) for k in order) for r in want.fetchall()), key=repr)


def test_prism_keeps_all_its_vertices(spark):
    ring = tuple((10 * math.cos(2 * math.pi * k / 48), 10 * math.sin(2 * math.pi * k / 48)) for k in range(48))
    points = spark.createDataFrame([(0, 0.0, 5.0, 0.0), (1, 0.0, -5.0, 0.0), (2, 5.0, -3.0, 0.0), (3, 9.0, 9.0, 0.0)], "gid long, x double, y double, z double")
    assert sorted(r.gid for r in RG.crop(points, RG.Region("prism", (0.0, 0.0, 0.0), polygon=ring)).collect()) == [0, 1, 2]


def test_drawn_outlines_are_simplified():
    ring = [(320 + 200 * math.cos(k / 50 * 2 * math.pi), 240 + 200 * math.sin(k / 50 * 2 * math.pi)) for k in range(50)]
    prism = RG.prism_from_screen(ring, 640, 480, (0, -10, 0), (0, 0, 0), (0, 0, 1), 60.0, ((-1, -1, -1), (1, 1, 1)))
    assert 8 <= len(prism.polygon) <= RG.MOST_VERTICES and prism.center == pytest.approx((0, 0, 0), abs=0.2)
    assert M.quaternion(*prism.quat)[:, 2] == pytest.approx([0, -1, 0]) and prism.half[2] == pytest.approx(1.1, abs=0.01)
    with pytest.raises(ValueError):
        RG.prism_from_screen(ring[:2], 640, 480, (0, -10, 0), (0, 0, 0), (0, 0, 1), 60.0, ((-1,) * 3, (1,) * 3))


def test_quaternions_come_back():
    rng = np.random.default_rng(2)
    for _ in range(20):
        q = rng.standard_normal(4)
        q = q / np.linalg.norm(q) * np.sign(q[0])
        assert M.quaternion_of(M.quaternion(*q)) == pytest.approx(tuple(q))
    assert M.placement((5, 6, 7), (1, 2, 3))[:3, 3] == pytest.approx([4, 4, 4])


def test_estimates_bracket_the_truth(spark):
    rng = np.random.default_rng(4)
    cloud = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(rng.random((3000, 3)) * 10)], "gid long, x double, y double, z double")
    leaves = L.leaf_bounds(L.with_leaf(cloud, 2.0), 2.0).cache()
    for region in (RG.Region("box", (5.0, 5.0, 5.0), (3.0, 2.0, 4.0), quat=(0.9, 0.1, 0.3, 0.2)), RG.Region("sphere", (4.0, 5.0, 6.0), radius=4.0), RG.Region("slab", (5.0, 5.0, 5.0), (1.0, 1.0, 2.0)), RG.Region("prism", (5.0, 5.0, 5.0), (1.0, 1.0, 5.0), polygon=((-4.0, -4.0), (4.0, -4.0), (0.0, 4.0)))):
        marks = leaves.select("leaf", RG.classified(region).alias("mark"))
        truth = L.with_leaf(cloud, 2.0).groupBy("leaf").agg(F.avg(region.inside().cast("double")).alias("share"))
        wrong = marks.join(truth, "leaf").where("(mark = 1 and share < 1) or (mark = 0 and share > 0)").count()
        assert wrong == 0 and len({r.mark for r in marks.collect()}) > 1


def test_contours_stop_and_footprints_fit_their_budget(spark):
    n = 24
    hill = spark.createDataFrame([(u, v, float(12 - max(abs(u - 12), abs(v - 12)))) for u in range(n) for v in range(n)], "u long, v long, value double")
    lines = R.contours(hill, 1.0).collect()
    assert {r.level for r in lines} >= {3.0, 8.0} and all(r.closed for r in lines if 3 <= r.level <= 8)
    assert all(len(r.points) < 40 for r in lines)
    few = {r.level for r in R.contours(hill, 1.0, most=3).collect()}
    assert few < {r.level for r in lines} and min(few) == min(r.level for r in lines)
    ring = [(k, 5 + 4 * math.cos(k / 100 * math.pi), 5 + 4 * math.sin(k / 100 * math.pi), 1.0) for k in range(200)]
    wall = spark.createDataFrame(ring, "gid long, x double, y double, z double")
    whole = R.footprint(wall, 0.25, 1.0, 0.2, low={"x": 0.0, "y": 0.0}, budget=10_000).agg(F.sum(F.size("points"))).first()[0]
    assert R.footprint(wall, 0.25, 1.0, 0.2, low={"x": 0.0, "y": 0.0}, budget=whole // 2).agg(F.sum(F.size("points"))).first()[0] <= whole // 2
    with pytest.raises(Exception, match="wider"):
        R.full_grid(spark.createDataFrame([(0, 0, 1.0), (5000, 1, 1.0)], "u long, v long, value double")).count()


def test_surfaces_without_normals(spark):
    shell = _shell(spark, 20_000).select("gid", "x", "y", "z")
    measured = ME.measure(*ME.build_surface(shell, 0.1, 0)).first()
    assert measured["triangles"] > 1000 and measured["boundary_edges"] == 0
    assert ME.recommended_source(measured.asDict(), False)["source"] == "points"
    assert ME.recommended_source(measured.asDict(), True)["source"] == "mesh" and ME.recommended_source(None, True)["source"] == "points"


def test_samples_carry_normals_and_colours(spark):
    v, t = cube(spark)
    painted = v.withColumns({"r": F.lit(200), "g": (F.col("x") * 100).cast("int"), "b": F.lit(0), "nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(2.0)})
    rows = ME.sample(painted, t, 777).collect()
    assert len(rows) == 777 and all(r.r == 200 and abs(r.g - 100 * r.x) <= 0.51 and r.nz == pytest.approx(1) for r in rows)
    faces = sum(r.z < 1e-9 for r in rows)
    assert 80 < faces < 180  # a sixth of the area


def test_numbers(spark):
    rows = spark.createDataFrame([(0.1,)] * 10 + [(1e8,), (-1e8,)], "v double")
    assert rows.agg(C.exact_sum(F.col("v")).alias("s")).first().s == 1.0
    voxels = spark.createDataFrame([(0.001,), (0.05,), (0.0171,), (9.0,)], "s double").select(L.default_voxel(F.col("s")).alias("v"))
    assert [r.v for r in voxels.collect()] == [1.0, 10.0, 3.5, 60.0]


def test_e57_fields_meta_and_stride(spark, tmp_path):
    rows = [(k, k * 0.1, -k * 0.2, 5.0, k % 256, 1, 2, k % 256, 0.6, 0.0, 0.8) for k in range(3000)]
    cloud = spark.createDataFrame(rows, "gid long, x double, y double, z double, r int, g int, b int, intensity int, nx double, ny double, nz double")
    e57.write_e57(cloud, f"{tmp_path}/a.e57", "a & b")
    back = files.read(spark, f"{tmp_path}/a.e57").orderBy("gid").collect()
    assert [(r.gid, r.x, r.r, r.intensity) for r in back] == [(k, pytest.approx(k * 0.1), k % 256, k % 256) for k in range(3000)]
    assert back[7].nx == pytest.approx(0.6) and back[7].nz == pytest.approx(0.8)
    m = e57.meta(spark, f"{tmp_path}/a.e57").first()
    assert (m["name"], m.points, m.has_color, m.has_intensity, m.has_normals, m.bounds, m.fields) == ("a & b", 3000, True, True, True, None, 10)
    assert [r.gid for r in e57.read_e57(spark, f"{tmp_path}/a.e57", stride=1000).orderBy("gid").collect()] == [0, 1000, 2000]
    turned = e57.declared_bounds({"bounds": [[0, 0, 0], [1, 2, 3]], "rotation": [math.sqrt(0.5), 0, 0, math.sqrt(0.5)]})
    assert turned == pytest.approx([-2, 0, 0, 0, 1, 3])


def test_e57_images(spark, tmp_path):
    """A file of one picture, written page by page here."""
    picture = bytes(range(256)) * 9
    body = bytearray(b"\0" * 48) + struct.pack("<B7xQ", 0, len(picture) + 16) + picture
    start = len(body)
    physical = lambda at: at // 1020 * 1024 + at % 1020
    xml = f'<e57Root><images2D type="Vector"><vectorChild><name>pano</name><pose><rotation><w>1</w><x>0</x><y>0</y><z>0</z></rotation><translation><x>1</x><y>2</y><z>3</z></translation></pose><sphericalRepresentation><jpegImage type="Blob" fileOffset="{physical(48)}" length="{len(picture)}"/><imageWidth>20</imageWidth><imageHeight>10</imageHeight></sphericalRepresentation></vectorChild></images2D></e57Root>'.encode()
    body += xml + b"\0" * (-(start + len(xml)) % 1020)
    struct.pack_into("<8sIIQQQQ", body, 0, b"ASTM-E57", 1, 0, len(body) // 1020 * 1024, physical(start), len(xml), 1024)
    (tmp_path / "p.e57").write_bytes(b"".join(bytes(body[k : k + 1020]) + b"\0\0\0\0" for k in range(0, len(body), 1020)))
    row = e57.images(spark, f"{tmp_path}/p.e57", with_bytes=True).first()
    assert (row["name"], row["view"], row.w, row.h, row.t, row.size) == ("pano", "spherical", 20, 10, [1.0, 2.0, 3.0], len(picture)) and bytes(row["bytes"]) == picture


def test_cache_and_keys(spark, tmp_path):
    cloud = spark.range(5).selectExpr("id as gid", "id * 1.0D as x", "0D as y", "0D as z")
    cache = files.Cache(spark, f"file://{tmp_path}/cache")
    assert cache.keys() == [] and not cache.has("a")
    cache.write("a", cloud)
    cache.write("b", cloud.limit(2))
    assert cache.keys() == ["a", "b"] and cache.read("a").count() == 5 and cache.drop("a") and not cache.drop("a") and cache.keys() == ["b"]
    assert files.cache_key("a.las", 10, 5) != files.cache_key("a.las", 10, 5, 2) and files.cache_key("", 0, 0).startswith(files.cache_key("", 0, 0)[:8])


def test_meshes_are_told_from_clouds(spark, tmp_path):
    head = "ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\n"
    (tmp_path / "cloud.ply").write_text(head + "element face 0\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n0 1 0\n")
    (tmp_path / "mesh.ply").write_text(head + "element face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    assert files.looks_like_mesh(f"{tmp_path}/cloud.ply") is None and files.looks_like_mesh(f"{tmp_path}/mesh.ply") == "ply"
    s = Session(spark)
    assert s.run("open", path=f"{tmp_path}/cloud.ply") == {"layer": "cloud.ply"} and s.run("open", path=f"{tmp_path}/mesh.ply") == {"mesh": "mesh.ply"}
    assert s.run("mesh", op="measure", name="mesh.ply")["area"] == pytest.approx(0.5)


def test_session_commands(spark, tmp_path):
    flat = spark.range(400).selectExpr("id as gid", "(id % 20) * 0.1D as x", "floor(id / 20) * 0.1D as y", "0D as z")
    s = Session(spark)
    for name in "abc":
        s.add(name, flat)
    s.run("entities", op="hide", name="b")
    s.run("entities", op="merge")
    assert list(s.layers) == ["a", "b"] and s.run("state")["points"] == 800
    s.run("history", op="save", path=f"{tmp_path}/saved")
    assert spark.read.parquet(f"{tmp_path}/saved").count() == 800
    # A layer scaled up tenfold is analysed as it stands: a metre apart, no two points are within half a metre.
    s.run("entities", op="activate", name="b")
    s.run("transform", op="scale", factor=10.0, about=[0, 0, 0])
    assert s.run("analysis", op="subsample", spacing=0.5)["points"] == 400
    assert s.run("analysis", op="subsample", spacing=2.0)["points"] == 100
    assert s.run("regions", op="place", at=[5, 5, 0], kind="sphere")["region"] == "r1" and s.regions["r1"].radius == pytest.approx(0.19, abs=0.02)
    reply = s.run("regions", op="lasso", polygon=[[0, 0], [640, 0], [640, 480], [0, 480]], camera={"width": 640, "height": 480, "eye": [9, 9, 40], "target": [9, 9, 0], "up": [0, 1, 0], "fov": 60.0})
    assert reply["vertices"] == 4 and s.run("inside", region={"kind": "prism", "center": list(s.regions["r2"].center), "half": list(s.regions["r2"].half), "quat": list(s.regions["r2"].quat), "polygon": [list(p) for p in s.regions["r2"].polygon]})["n"] == 100
    hit = s.run("probe", px=0, py=0, perPixel=1.0, reach=1)
    assert hit["hit"] and hit["gid"] == 0 and not s.run("probe", px=900, py=0)["hit"]
    assert s.run("cache", op="write", path=f"{tmp_path}/c", key="k") == {"key": "k"} and s.run("cache", op="list", path=f"{tmp_path}/c") == {"keys": ["k"]}
    assert s.run("cache", op="has", path=f"{tmp_path}/c", key="k")["has"] and s.run("cache", op="drop", path=f"{tmp_path}/c", key="k")["dropped"]
    s.run("export", path=f"{tmp_path}/b.e57", format="e57")
    assert files.read(spark, f"{tmp_path}/b.e57").count() == 100
    assert s.run("contours", interval=0.5, cell=1.0) == {"lines": 0, "levels": 0, "vertices": 0}
    quiet = Session(spark, allow_edits=False)
    quiet.add("a", flat)
    assert quiet.run("transform")["scale"] == pytest.approx(1) and quiet.run("regions") == {"regions": []}
    replies = quiet.run("script", steps=[{"command": "state"}, {"command": "transform", "args": {"op": "reset"}}])["replies"]
    assert replies[0]["points"] == 400 and "off" in replies[1]["error"]
