"""Round trips of file formats, sessions with history and scripts, streams, and the driver's entry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.plans.catalogue import cube
from pointloom.session import Session
from pointloom.sources import files
from pointloom.streaming.ingest import append_layer, sessions, thin_stream


@pytest.fixture(scope="module")
def points(spark):
    i, j = F.col("id") % 20, F.floor(F.col("id") / 20)
    return spark.range(400).select(F.col("id").alias("gid"), (i * 0.1).alias("x"), (j * 0.1).alias("y"), (i * j / 400).alias("z"), i.cast("int").alias("r"), j.cast("int").alias("g"), F.lit(7).alias("b"), (F.col("id") % 256).cast("int").alias("intensity"))


def same(a, b, places=3):
    left, right = a.orderBy("gid").toPandas(), b.orderBy("gid").toPandas()
    assert len(left) == len(right)
    for c in ("x", "y", "z"):
        assert np.abs(left[c] - right[c]).max() < 10**-places
    for c in ("r", "g", "b"):
        assert (left[c] == right[c]).all()


def test_ply_and_las(spark, points, tmp_path):
    files.write_ply(points, f"{tmp_path}/a.ply")
    assert files.sniff(f"{tmp_path}/a.ply") == "ply"
    same(files.read(spark, f"{tmp_path}/a.ply"), points, 9)
    files.write_las(points, f"{tmp_path}/a.las")
    assert files.sniff(f"{tmp_path}/a.las") == "las"
    las = files.read(spark, f"{tmp_path}/a.las")
    same(las, points)
    assert las.where("gid = 77").first().intensity == 77


def test_e57(spark, points, tmp_path):
    from pointloom.sources import e57

    e57.write_e57(points, f"{tmp_path}/a.e57")
    assert files.sniff(f"{tmp_path}/a.e57") == "e57"
    same(files.read(spark, f"{tmp_path}/a.e57"), points, 9)
    assert e57.stations(spark, f"{tmp_path}/a.e57").first().name == "scan"
    rng = np.random.default_rng(1)
    values = rng.integers(-5, 3000, 500)
    field = {"kind": "ScaledInteger", "low": -5, "high": 3000, "scale": 0.01, "offset": 2.0}
    raw = np.packbits(np.array([[(v + 5) >> k & 1 for k in range(12)] for v in values], np.uint8).ravel(), bitorder="little").tobytes()
    assert np.allclose(e57._decode(field, raw, 0, 500), values * 0.01 + 2) and np.allclose(e57._decode(field, raw, 12 * 7, 100), values[7:107] * 0.01 + 2)
    assert (e57._decode({"kind": "Integer", "low": 4, "high": 4, "scale": 1, "offset": 0}, b"", 0, 3) == 4).all()
    assert e57._crc32c(np.frombuffer(b"123456789", np.uint8)[None])[0] == 0xE3069283


def test_ascii_ply_and_text(spark, tmp_path):
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n1 2 3 4 5 6\n7 8 9 10 11 12\n")
    assert [tuple(r) for r in files.read(spark, f"{tmp_path}/b.ply").orderBy("gid").collect()] == [(0, 1.0, 2.0, 3.0, 4, 5, 6), (1, 7.0, 8.0, 9.0, 10, 11, 12)]
    (tmp_path / "c.csv").write_text("Northing,Easting,Height,Red,Green,Blue\n1,2,3,255,0,9\n# no\n\nnan,1,1,1,1,1\n4,5,6,1,2,3\n")
    got = files.read(spark, f"{tmp_path}/c.csv").orderBy("gid").collect()
    assert [(r.x, r.y, r.z, r.r) for r in got] == [(2.0, 1.0, 3.0, 255), (5.0, 4.0, 6.0, 1)]
    (tmp_path / "d.xyz").write_text("0 0 1 -0.5\n1 0 1 0.0\n")
    assert [r.intensity for r in files.read(spark, f"{tmp_path}/d.xyz").orderBy("gid").collect()] == [64, 127]


def test_ptx(spark, tmp_path):
    head = "1\n2\n{0} 0 0\n1 0 0\n0 1 0\n0 0 1\n1 0 0 0\n0 1 0 0\n0 0 1 0\n{0} 0 0 1\n"
    (tmp_path / "e.ptx").write_text(head.format(0) + "1 1 1 0.5 1 2 3\n0 0 0 0 0 0 0\n" + head.format(5) + "1 1 1 0.5 1 2 3\n2 1 1 0.5 1 2 3\n")
    cloud, stations = files.read_ptx(spark, f"{tmp_path}/e.ptx")
    assert sorted(r.x for r in cloud.collect()) == [1.0, 6.0, 7.0] and [r.x for r in stations.orderBy("sid").collect()] == [0.0, 5.0]


@pytest.mark.parametrize("kind", ["obj", "stl", "ply"])
def test_meshes(spark, tmp_path, kind):
    from pointloom.operators.mesh import measure

    files.write_mesh(*cube(spark), f"{tmp_path}/m.{kind}")
    m = measure(*files.read_mesh(spark, f"{tmp_path}/m.{kind}")).first()
    assert m.area == pytest.approx(6) and m.volume == pytest.approx(1) and m.closed


def test_session(spark, points):
    s = Session(spark)
    s.add("a", points)
    assert s.run("state")["points"] == 400
    s.run("regions", op="add", region={"kind": "box", "center": [0.5, 0.5, 0.5], "half": [0.55, 0.55, 5.0], "role": "keep"})
    s.run("regions", op="apply")
    assert s.run("state")["points"] == 121
    assert s.run("history", op="undo") == {"at": 0, "versions": 2} and s.run("state")["points"] == 400
    s.run("history", op="redo")
    s.run("transform", op="translate", translation=[10, 0, 0])
    assert s.run("state")["xmin"] == pytest.approx(10)
    s.run("entities", op="clone", name="a", to="b")
    s.run("transform", op="reset")
    s.run("entities", op="merge")
    assert s.run("state")["points"] == 242
    reply = s.run("script", steps=[{"command": "distance", "args": {"a": [0, 0, 0], "b": [3, 4, 12]}, "as": "d"}, {"command": "regions", "args": {"op": "add", "region": {"id": "n${d.dz}", "kind": "sphere", "center": [0, 0, 0], "radius": "$d.distance"}}}, {"command": "nothing"}, {"command": "state"}])
    assert len(reply["replies"]) == 3 and reply["replies"][1] == {"region": "n12.0"} and "error" in reply["replies"][2]
    s.meshes["cube"] = cube(spark)
    assert s.run("mesh", op="measure", name="cube")["area"] == pytest.approx(6)
    assert s.run("mesh", op="flip", name="cube")["volume"] == pytest.approx(1)
    assert s.run("section", axis="x", at=0.0, thickness=0.01)["points"] > 0
    assert s.run("log", limit=1)["entries"][0]["command"] == "section"
    quiet = Session(spark, allow_edits=False)
    quiet.add("a", points)
    with pytest.raises(PermissionError):
        quiet.run("analysis", op="subsample")
    assert quiet.run("transform", op="get")["scale"] == pytest.approx(1)


def test_streams(spark, points, tmp_path):
    source = points.withColumn("ts", F.timestamp_seconds(F.col("gid") * 100))
    source.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    append_layer(thin_stream(stream, 0.5), f"{tmp_path}/layer", f"{tmp_path}/check").awaitTermination(120)
    cells = source.select(*[F.floor(F.col(c) / 0.5) for c in "xyz"]).distinct().count()
    assert spark.read.parquet(f"{tmp_path}/layer").count() >= cells
    got = sessions(source.withColumn("ts", F.timestamp_seconds(F.floor(F.col("gid") / 100) * 10_000 + F.col("gid"))), "b").collect()
    assert [r.n for r in sorted(got, key=lambda r: r.start)] == [100] * 4


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
