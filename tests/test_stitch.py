"""Contour lines over many small tiles against one tile, a spiral through all of them, rings, and corners met exactly."""

import math

import pytest
from pyspark.sql import functions as F

from pointloom.operators import raster as R


def shape(lines):
    """Lines as sets of segments, whichever way round and wherever they begin."""
    out = []
    for r in lines.collect():
        p = [(q.x, q.y) for q in r.points]
        assert r.closed == (p[0] == p[-1]) and len(p) > 1
        out.append((r.level, r.closed, frozenset(frozenset(s) for s in zip(p, p[1:], strict=False))))
    return sorted(out, key=lambda x: (x[0], x[1], sorted(sorted(s) for s in x[2])))


def test_tiles_change_nothing(spark):
    heights = spark.range(60 * 60).select((F.col("id") % 60).alias("u"), F.floor(F.col("id") / 60).alias("v"))
    heights = heights.withColumn("value", F.sin(F.col("u") * 0.31) * 4 + F.cos(F.col("v") * 0.23) * 3 + F.sin((F.col("u") + F.col("v")) * 0.11))
    segments = R.contour_segments(heights, [-2.0, 0.1, 3.0]).cache()
    whole, tiled = shape(R.stitch(segments)), shape(R.stitch(segments, 5))
    assert whole == tiled and any(c for _, c, _ in whole) and any(not c for _, c, _ in whole)
    ids = R.stitch(segments, 5).select("level", "line")
    assert ids.distinct().count() == ids.count() == len(whole)


@pytest.mark.parametrize("closed", [False, True])
def test_one_line_through_all_tiles(spark, closed):
    n = 6000
    turn = lambda k: (math.cos(k * 0.02) * (20 + k * 0.01), math.sin(k * 0.02) * (20 + k * 0.01))
    ring = lambda k: (300 * math.cos(2 * math.pi * k / n), 300 * math.sin(2 * math.pi * k / n))
    at = ring if closed else turn
    rows = [(1.0, *at(k), *at((k + 1) % n)) if k % 2 else (1.0, *at((k + 1) % n), *at(k)) for k in range(n if closed else n - 1)]
    got = R.stitch(spark.createDataFrame(rows, "level double, x1 double, y1 double, x2 double, y2 double").repartition(5), 8).collect()
    assert len(got) == 1 and got[0].closed == closed and len(got[0].points) == (n + 1 if closed else n)
    steps = [math.dist((a.x, a.y), (b.x, b.y)) for a, b in zip(got[0].points, got[0].points[1:], strict=False)]
    assert max(steps) < 2 * max(math.dist(at(k), at(k + 1)) for k in range(n - 1))  # in order along the line


def test_corners_met_exactly_and_nothing(spark):
    peak = spark.createDataFrame([(u, v, float(max(0, 2 - abs(u - 2) - abs(v - 2)))) for u in range(5) for v in range(5)], "u long, v long, value double")
    segments = R.contour_segments(peak, [1.0])
    assert shape(R.stitch(segments, 1)) == shape(R.stitch(segments)) and len(shape(R.stitch(segments))) == 1
    none = R.stitch(segments.where("false"), 4)
    assert none.count() == 0 and none.columns == ["level", "line", "points", "closed"]
