"""Rasters as sparse tables (u, v, value): aggregates by cell, filling, grey maps, volumes, contours, footprints."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.columns import cell
from pointloom.plans.lineage import cut, discard
from pointloom.plans.stars import components

PLANES = {"x": ("y", "z"), "y": ("x", "z"), "z": ("x", "y")}
LEAST_CELL, MOST_RINGS, ENOUGH = 0.005, 12, 8
#: Cells along either side of a raster whose empty cells are wanted, lines after which no further level is drawn.
MOST_SIDE, MOST_LINES = 2048, 400


def raster(cloud: DataFrame, size: float, stat: str = "max", axis: str = "z", field: str | None = None, box: dict | None = None) -> DataFrame:
    """(u, v, value): max, min, mean of the axis, count as density, or mean of a field, by cell from the cloud's low corner."""
    size, (a, b) = max(size, LEAST_CELL), PLANES[axis]
    low = box or cloud.agg(F.min(a).alias(a), F.min(b).alias(b)).first().asDict()
    value = {"max": F.max(axis), "min": F.min(axis), "mean": F.avg(axis), "density": F.count("*").cast("double"), "field": F.avg(field or axis)}[stat]
    return cloud.groupBy(cell(F.col(a) - low[a], size).alias("u"), cell(F.col(b) - low[b], size).alias("v")).agg(value.alias("value"))


def full_grid(table: DataFrame, most: int = MOST_SIDE) -> DataFrame:
    """(u, v, value) of every cell of the bounding rectangle, null where empty; an error where a side has over ``most``."""
    ends = table.agg(F.min("u").alias("a"), F.max("u").alias("b"), F.min("v").alias("c"), F.max("v").alias("d"))
    side = F.greatest(F.col("b") - F.col("a"), F.col("d") - F.col("c")) + 1
    ends = ends.where(F.when(side > most, F.raise_error(F.concat(F.lit("a side has "), side.cast("string"), F.lit(" cells: take wider ones"))).isNull()).otherwise(F.lit(True)))
    cells = ends.select(F.explode(F.sequence("a", "b")).alias("u"), "c", "d").select("u", F.explode(F.sequence("c", "d")).alias("v"))
    return cells.join(table, ["u", "v"], "left")


def fill(table: DataFrame, how: str = "nearest", rings: int = MOST_RINGS) -> DataFrame:
    """Fills empty cells from the filled ones around: the nearest of the first ring that has any, or 1/d² until enough are found."""
    grid = full_grid(table)
    empty = grid.where("value is null").select("u", "v")
    span = F.explode(F.sequence(F.lit(-rings), F.lit(rings)))
    near = empty.select("u", "v", span.alias("i")).select("u", "v", "i", span.alias("j"))
    ring = F.greatest(F.abs("i"), F.abs("j"))
    known = table.select(F.col("u").alias("_u"), F.col("v").alias("_v"), "value")
    met = near.join(known, (F.col("u") + F.col("i") == F.col("_u")) & (F.col("v") + F.col("j") == F.col("_v"))).select("u", "v", ring.alias("ring"), (F.col("i") * F.col("i") + F.col("j") * F.col("j")).alias("d2"), F.col("i"), F.col("j"), "value")
    if how == "nearest":
        new = met.groupBy("u", "v").agg(F.min(F.struct("ring", "d2", "j", "i", "value")).alias("b")).select("u", "v", F.col("b.value").alias("value"))
    else:
        each = met.groupBy("u", "v", "ring").agg(F.count("*").alias("n"), F.sum(F.col("value") / F.col("d2")).alias("s"), F.sum(F.lit(1.0) / F.col("d2")).alias("w"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("u", "v").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        new = each.withColumn("before", before).where(F.col("before") < ENOUGH).groupBy("u", "v").agg((F.sum("s") / F.sum("w")).alias("value"))
    return table.select("u", "v", "value").unionAll(new)


def grey(table: DataFrame) -> DataFrame:
    """(u, v, grey): 1 to 255 between the least and the greatest value."""
    ends = table.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    share = (F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return table.crossJoin(F.broadcast(ends)).select("u", "v", (F.floor(F.coalesce(share, F.lit(0.0)) * 254.0 + 0.5) + 1).cast("int").alias("grey"))


def volume(active: DataFrame, size: float, plane: float | None = None, reference: DataFrame | None = None) -> DataFrame:
    """(added, removed, net, area, cells): between a raster and a plane, or another raster filled by 1/d²."""
    if reference is not None:
        below = fill(reference, "idw").withColumnRenamed("value", "base")
        joined = active.join(below, ["u", "v"])
    else:
        joined = active.withColumn("base", F.lit(float(plane)))
    d = (F.col("value") - F.col("base")) * (size * size)
    zero = F.lit(0.0)
    return joined.agg(F.coalesce(F.sum(F.when(d > 0, d)), zero).alias("added"), F.coalesce(F.sum(F.when(d < 0, -d)), zero).alias("removed"), F.coalesce(F.sum(d), zero).alias("net"), (F.count("*") * (size * size)).alias("area"), F.count("*").alias("cells"))


#: For each set of corners above the level (bits: low left, low right, high right, high left), the edges that segments join; edges from the bottom, counter-clockwise.
SEGMENTS = {1: ((3, 0),), 2: ((0, 1),), 3: ((3, 1),), 4: ((1, 2),), 5: ((3, 0), (1, 2)), 6: ((0, 2),), 7: ((3, 2),), 8: ((2, 3),), 9: ((2, 0),), 10: ((0, 1), (2, 3)), 11: ((2, 1),), 12: ((1, 3),), 13: ((1, 0),), 14: ((0, 3),)}


def _squares(table: DataFrame) -> DataFrame:
    """(u, v, a, b, c, d): the four corner values of each square all of whose corners exist. Corners meet in one group-by."""
    moves = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]))
    corners = table.select("u", "v", "value", moves.alias("m")).select((F.col("u") - F.col("m.i")).alias("u"), (F.col("v") - F.col("m.j")).alias("v"), "value", F.col("m.k").alias("k"))
    picked = [F.max(F.when(F.col("k") == k, F.col("value"))).alias(n) for k, n in enumerate("abcd")]
    return corners.groupBy("u", "v").agg(*picked, F.count("*").alias("n")).where("n = 4").drop("n")


def contour_segments(table: DataFrame, levels: list[float], midpoints: bool = False) -> DataFrame:
    """(level, x1, y1, x2, y2) in cells: marching squares, ends interpolated along edges or at their middles."""
    level = F.col("level")
    squares = _squares(table).withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels]))) if levels else _squares(table).withColumn("level", F.lit(0.0)).where("false")
    case = sum((F.when(F.col(n) >= level, 1 << k).otherwise(0) for k, n in enumerate("bcd", 1)), F.when(F.col("a") >= level, 1).otherwise(0))

    def between(p: str, q: str) -> Column:
        return F.lit(0.5) if midpoints else F.coalesce((level - F.col(p)) / F.nullif(F.col(q) - F.col(p), F.lit(0.0)), F.lit(0.5))

    u, v = F.col("u").cast("double"), F.col("v").cast("double")
    edges = [(u + between("a", "b"), v), (u + 1.0, v + between("b", "c")), (u + between("d", "c"), v + 1.0), (u, v + between("a", "d"))]
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    found = none
    for k, ends in SEGMENTS.items():
        lines = F.array(*[F.struct(edges[s][0].alias("x1"), edges[s][1].alias("y1"), edges[e][0].alias("x2"), edges[e][1].alias("y2")) for s, e in ends])
        found = F.when(F.col("case") == k, lines).otherwise(found)
    crossed = squares.withColumn("case", case).where("case > 0 and case < 15")
    return crossed.select("level", F.explode(found).alias("s")).select("level", "s.*")


#: Cells along either side of a tile in which one task joins a level's segments.
STITCHED = 1024
LINE = "level double, points array<struct<x:double,y:double>>, closed boolean"


def _pieces(pdf):
    """Segments of one level and tile, joined end to end; of lines that cross no tile's edge these are the whole."""
    import pandas as pd

    ends: dict[tuple, list[int]] = {}
    rows = [((round(r.x1, 9), round(r.y1, 9)), (round(r.x2, 9), round(r.y2, 9))) for r in pdf.sort_values(["y1", "x1", "y2", "x2"]).itertuples()]
    rows = [(p, q) for p, q in rows if p != q]  # a level that meets a corner exactly
    for k, (p, q) in enumerate(rows):
        ends.setdefault(p, []).append(k)
        ends.setdefault(q, []).append(k)
    used, lines = [False] * len(rows), []
    for k in [*[k for k, (p, q) in enumerate(rows) if len(ends[p]) == 1 or len(ends[q]) == 1], *range(len(rows))]:
        if used[k]:
            continue
        used[k] = True
        p, q = rows[k]
        line = [q, p] if len(ends[q]) == 1 else [p, q]
        while True:
            following = next((j for j in ends[line[-1]] if not used[j]), None)
            if following is None:
                break
            used[following] = True
            s, e = rows[following]
            line.append(e if s == line[-1] else s)
        lines.append(line)
    level = pdf["level"].iloc[0]
    return pd.DataFrame([{"level": level, "points": [{"x": x, "y": y} for x, y in line], "closed": line[0] == line[-1]} for line in lines], columns=["level", "points", "closed"])


def stitch(segments: DataFrame, tile: int = STITCHED) -> DataFrame:
    """(level, line, points, closed): segments joined end to end.

    Tasks join what lies in tiles of ``tile`` cells. Pieces that meet at a tile's edge are tied there, two and two, and each
    piece finds its rank in its line by doubling: in every round it knows twice as many pieces ahead. So a line may cross
    any number of tiles, and no task holds more than one tile of a level, or one whole line."""
    at = [F.floor((F.col(f"{c}1") + F.col(f"{c}2")) / (2.0 * tile)).alias(f"t{c}") for c in "xy"]
    pieces = segments.select("level", "x1", "y1", "x2", "y2", *at).groupBy("level", "tx", "ty").applyInPandas(_pieces, LINE)
    pieces = cut(pieces.withColumn("piece", F.monotonically_increasing_id()))
    open_ = pieces.where("not closed").select("level", "piece", F.element_at("points", 1).alias("p0"), F.element_at("points", -1).alias("p1"))
    ports = open_.select("level", "piece", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"p{k}").alias("p")) for k in (0, 1)])).alias("e"))
    # Few ends share a place: as many as segments can meet in one point of a grid.
    met = ports.groupBy("level", "e.p.x", "e.p.y").agg(F.array_sort(F.collect_list(F.struct("piece", "e.side"))).alias("ends")).where("size(ends) > 1")
    two = met.select(F.explode(F.sequence(F.lit(1), F.floor(F.size("ends") / 2).cast("int"))).alias("k"), "ends").select(F.element_at("ends", F.col("k") * 2 - 1).alias("a"), F.element_at("ends", F.col("k") * 2).alias("b"))
    both = two.select("a", "b").unionAll(two.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = cut(both.select(F.col("a.piece").alias("piece"), F.col("a.side").alias("side"), F.col("b.piece").alias("other"), F.col("b.side").alias("at")))
    if links.isEmpty():
        return pieces.select("level", F.col("piece").alias("line"), "points", "closed")
    named = cut(components(links.select(F.col("piece").alias("a"), F.col("other").alias("b"))))
    # A piece that ends where it began by way of others has no free end anywhere in its line: a ring, cut before its least piece.
    free = links.groupBy("piece").count().join(named, F.col("piece") == F.col("node")).groupBy("component").agg(F.sum("count").alias("ends"), F.count("*").alias("n"))
    alone = links.where("piece = other").select(F.col("piece").alias("component")).distinct()  # a ring of one piece
    rings = free.where("ends = 2 * n").select("component").unionAll(alone).distinct()
    cut_at = rings.select(F.col("component").alias("piece"), F.lit(0).alias("side"))
    kept = links.join(cut_at, ["piece", "side"], "left_anti").join(cut_at.withColumnsRenamed({"piece": "other", "side": "at"}), ["other", "at"], "left_anti")
    # A state is a piece and the side it is left by; what follows is the next piece, left by the side it is not entered by.
    states = named.select(F.col("node").alias("piece"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    ahead = cut(states.join(kept, ["piece", "side"], "left").select("piece", "side", "other", (1 - F.col("at")).alias("out"), F.when(F.col("other").isNull(), 0).otherwise(1).cast("long").alias("far"), F.coalesce("other", "piece").alias("end"), F.coalesce(1 - F.col("at"), F.col("side")).alias("end_side")))
    while not ahead.where("other is not null").isEmpty():
        there = ahead.select(F.col("piece").alias("other"), F.col("side").alias("out"), F.col("other").alias("_other"), F.col("out").alias("_out"), F.col("far").alias("_far"), F.col("end").alias("_end"), F.col("end_side").alias("_side"))
        more = ahead.join(there, ["other", "out"], "left")
        after = cut(more.select("piece", "side", F.col("_other").alias("other"), F.col("_out").alias("out"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.coalesce("_end", "end").alias("end"), F.coalesce("_side", "end_side").alias("end_side")))
        discard(ahead)
        ahead = after
    # Both ways out of a piece reach an end of its line; the line begins at the lesser of the two.
    ways = ahead.groupBy("piece").agg(*[F.max(F.when(F.col("side") == k, F.struct("end", "end_side", "far"))).alias(f"w{k}") for k in (0, 1)])
    first = F.struct("w0.end", "w0.end_side") <= F.struct("w1.end", "w1.end_side")
    placed = ways.select("piece", F.when(first, F.col("w0.far")).otherwise(F.col("w1.far")).alias("rank"), first.alias("onward"))
    placed = placed.join(named, F.col("piece") == F.col("node")).select("piece", "rank", "onward", F.col("component").alias("line"))
    parts = pieces.join(placed, "piece").select("level", "line", "rank", F.when(F.col("onward"), F.col("points")).otherwise(F.reverse("points")).alias("points"))
    lined = parts.groupBy("level", "line").agg(F.array_sort(F.collect_list(F.struct("rank", "points"))).alias("parts"))
    whole = F.concat(F.array(F.element_at("parts", 1)["points"][0]), F.flatten(F.transform("parts", lambda p: F.slice(p["points"], 2, F.greatest(F.size(p["points"]) - 1, F.lit(0))))))
    lined = lined.select("level", "line", whole.alias("points"))
    lined = lined.withColumn("closed", (F.element_at("points", 1)["x"] == F.element_at("points", -1)["x"]) & (F.element_at("points", 1)["y"] == F.element_at("points", -1)["y"]))
    single = pieces.join(placed.select("piece"), "piece", "left_anti").select("level", F.col("piece").alias("line"), "points", "closed")
    return single.unionAll(lined)


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Keeps the points that lie farther than ``tolerance`` from the chord of what is kept, by halving at the farthest."""
    if len(points) < 3:
        return points
    if points[0] == points[-1]:  # a ring: cut it at the point farthest from its start
        far = max(range(len(points)), key=lambda k: (points[k][0] - points[0][0]) ** 2 + (points[k][1] - points[0][1]) ** 2)
        return simplify(points[: far + 1], tolerance)[:-1] + simplify(points[far:], tolerance)
    keep, work = {0, len(points) - 1}, [(0, len(points) - 1)]
    while work:
        a, b = work.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5 or 1e-300
        away = [(abs((bx - ax) * (ay - points[k][1]) - (ax - points[k][0]) * (by - ay)) / length, k) for k in range(a + 1, b)]
        if away and max(away)[0] > tolerance:
            keep.add(k := max(away)[1])
            work += [(a, k), (k, b)]
    return [points[k] for k in sorted(keep)]


def simplified(lines: DataFrame, tolerance: float) -> DataFrame:
    """``lines`` (level, line, points, closed) with fewer points: none of those left out is farther than ``tolerance``."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            points = [simplify([(p["x"], p["y"]) for p in own], tolerance) for own in pdf["points"]]
            yield pd.DataFrame({"level": pdf["level"], "line": pdf["line"], "points": [[{"x": x, "y": y} for x, y in own] for own in points], "closed": pdf["closed"]})

    return lines.mapInPandas(run, "level double, line long, points array<struct<x:double,y:double>>, closed boolean")


def contours(table: DataFrame, interval: float, most: int = MOST_LINES, tolerance: float = 0.4) -> DataFrame:
    """(level, line, points, closed) of a raster, in cells: levels at multiples of ``interval`` from the least to the
    greatest value, each line simplified to ``tolerance`` of a cell; the level that reaches ``most`` lines is the last."""
    ends = table.agg(F.min("value"), F.max("value")).first()
    if ends[0] is None:
        return stitch(contour_segments(table, [0.0]))
    lines = cut(stitch(contour_segments(table, levels_of(ends[0], ends[1], max(0.001, interval)))))
    before = F.coalesce(F.sum("n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each level
    drawn = lines.groupBy("level").agg(F.count("*").alias("n")).withColumn("before", before).where(F.col("before") < most).select(F.col("level").alias("_l"))
    return simplified(lines.join(F.broadcast(drawn), F.col("level") == F.col("_l"), "left_semi"), tolerance)


def footprint(cloud: DataFrame, size: float, z: float, thickness: float, dilate: bool = False, budget: int = 4000, low: dict | None = None) -> DataFrame:
    """(level, line, points, closed): outlines, in cells, of where a slab has points. The tolerance starts at a quarter
    of a cell and doubles until all lines together have at most ``budget`` points, or none can lose any."""
    lines = cut(stitch(contour_segments(occupancy(cloud, size, z, thickness, dilate, low), [0.5], midpoints=True)))
    tolerance, last = 0.25, None
    while True:
        out = cut(simplified(lines, tolerance))
        n = out.agg(F.sum(F.size("points"))).first()[0] or 0
        if n <= budget or n == last:
            return out
        discard(out)
        tolerance, last = tolerance * 2, n


def occupancy(cloud: DataFrame, size: float, z: float, thickness: float, dilate: bool = False, low: dict | None = None) -> DataFrame:
    """(u, v, value): 1 in cells that a slab's points are nearest to, 0 in the two rings around them."""
    slab = cloud.where(F.abs(F.col("z") - z) <= thickness / 2)
    low = low or slab.agg(F.min("x").alias("x"), F.min("y").alias("y")).first().asDict()
    full = slab.select(*[F.floor((F.col(c) - (low[c] or 0.0)) / size + 0.5).cast("long").alias(n) for c, n in (("x", "u"), ("y", "v"))]).distinct()
    around = lambda t, r: t.select("u", "v", F.explode(F.sequence(F.lit(-r), F.lit(r))).alias("i")).select("u", "v", "i", F.explode(F.sequence(F.lit(-r), F.lit(r))).alias("j")).select((F.col("u") + F.col("i")).alias("u"), (F.col("v") + F.col("j")).alias("v")).distinct()
    full = around(full, 1) if dilate else full
    return around(full, 2).join(full.withColumn("_one", F.lit(1.0)), ["u", "v"], "left").select("u", "v", F.coalesce("_one", F.lit(0.0)).alias("value"))


def levels_of(lo: float, hi: float, interval: float) -> list[float]:
    import math

    first = math.ceil(lo / interval)
    return [k * interval for k in range(first, math.floor(hi / interval) + 1)]


def histogram(cloud: DataFrame, column: str, bins: int = 128) -> DataFrame:
    """(bin, n) between the least and the greatest value."""
    ends = cloud.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    place = F.least(F.floor((F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * float(bins)), F.lit(bins - 1))
    return cloud.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(place, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def trimmed_range(cloud: DataFrame, column: str, low: float = 0.02, high: float = 0.02, bins: int = 128) -> DataFrame:
    """(lo, hi): edges of the bins at which the running count passes ``low`` from below and ``high`` from above."""
    ends = cloud.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count(column).alias("_n"))
    upto = F.sum("n").over(Window.orderBy("bin"))  # as many rows as bins
    runs = histogram(cloud, column, bins).withColumn("upto", upto).crossJoin(F.broadcast(ends))
    width = (F.col("_hi") - F.col("_lo")) / float(bins)
    lo = F.min(F.when(F.col("upto") > F.col("_n") * low, F.col("_lo") + F.col("bin") * width))
    hi = F.min(F.when(F.col("upto") >= F.col("_n") * (1.0 - high), F.col("_lo") + (F.col("bin") + 1) * width))
    return runs.agg(lo.alias("lo"), hi.alias("hi"))


def ortho_view(cloud: DataFrame, right: tuple, up: tuple, toward: tuple, per_pixel: float) -> DataFrame:
    """(px, py, gid): the point nearest the eye in each pixel of an orthographic view; equal depths go to the least gid."""
    along = lambda d: reduce(lambda a, b: a + b, [F.col(c) * float(k) for c, k in zip("xyz", d, strict=True)])
    rows = cloud.select("gid", cell(along(right), per_pixel).alias("px"), cell(along(up), per_pixel).alias("py"), along(toward).alias("depth"))
    return rows.groupBy("px", "py").agg(F.max(F.struct("depth", (-F.col("gid")).alias("g"))).alias("b")).select("px", "py", (-F.col("b.g")).alias("gid"))


def view_mapping(right: tuple, up: tuple, toward: tuple, per_pixel: float) -> dict:
    """How pixels of ``ortho_view`` lie in the world: metres per pixel, the step of one pixel right and up, the axis to the eye."""
    step = lambda d: [float(k) * per_pixel for k in d]
    return {"metresPerPixel": per_pixel, "stepRight": step(right), "stepUp": step(up), "toward": [float(k) for k in toward]}


def probe(cloud: DataFrame, px: int, py: int, right: tuple, up: tuple, toward: tuple, per_pixel: float, reach: int = 0) -> DataFrame:
    """(gid, x, y, z): the point that a pixel of ``ortho_view`` shows, or the one in the nearest pixel within ``reach``.

    Only points that fall into those pixels are looked at."""
    along = lambda d: reduce(lambda a, b: a + b, [F.col(c) * float(k) for c, k in zip("xyz", d, strict=True)])
    u, v = cell(along(right), per_pixel) - px, cell(along(up), per_pixel) - py
    near = cloud.where((F.abs(u) <= reach) & (F.abs(v) <= reach))
    best = near.agg(F.min(F.struct((u * u + v * v).alias("away"), (-along(toward)).alias("depth"), "gid", "x", "y", "z")).alias("b"))
    return best.where("b is not null").select("b.gid", "b.x", "b.y", "b.z")


def _planes(view: np.ndarray) -> list[np.ndarray]:
    """(a, b, c, d) of the six sides of what a 4x4 projection shows, each at least 0 within."""
    return [view[3] + sign * view[k] for k in range(3) for sign in (1, -1)]


def leaves_seen(leaves: DataFrame, view: np.ndarray) -> DataFrame:
    """The leaves whose box (xmin to zmax) isn't wholly beyond one side of a view: what a picture needs to read."""
    seen = F.lit(True)
    for plane in _planes(view):
        ends = [F.col(f"{c}{'max' if k > 0 else 'min'}") * float(k) for c, k in zip("xyz", plane, strict=False)]
        seen = seen & (ends[0] + ends[1] + ends[2] + float(plane[3]) >= 0)
    return leaves.where(seen)


def _shown(cloud: DataFrame, view: np.ndarray, width: int, height: int) -> DataFrame:
    """The points within a view, with px, py (from the upper left) and depth along the sight. Where the view ends, the
    upright box around it goes to the scan as well."""
    corners = np.linalg.inv(view) @ np.array([[x, y, z, 1] for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)], float).T
    if np.abs(corners[3]).min() > 1e-9 * np.abs(corners[3]).max():
        places = corners[:3] / corners[3]
        for c, at in zip("xyz", places, strict=True):
            slack = 1e-6 * (1 + np.abs(at).max())
            cloud = cloud.where(F.col(c).between(float(at.min() - slack), float(at.max() + slack)))
    along = lambda r: F.col("x") * float(r[0]) + F.col("y") * float(r[1]) + F.col("z") * float(r[2]) + float(r[3])
    clip = cloud.withColumns({"_z": along(view[2]), "depth": along(view[3]), "_u": along(view[0]), "_v": along(view[1])})
    clip = clip.where((F.col("depth") > 0) & (F.col("depth") < float("inf")))  # NaN is above all in Spark
    for c in ("_z", "_u", "_v"):
        clip = clip.where(F.abs(c) <= F.col("depth"))
    place = lambda c, n: F.floor((F.col(c) / F.nullif(F.col("depth"), F.lit(0.0)) + 1.0) * (n / 2.0)).cast("long")
    out = clip.withColumns({"px": place("_u", width), "py": height - 1 - place("_v", height)}).drop("_z", "_u", "_v")
    return out.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))


def perspective_view(cloud: DataFrame, view: np.ndarray, width: int, height: int) -> DataFrame:
    """(px, py, gid, depth): the point nearest the eye in each pixel under a 4x4 projection (``matrix.perspective``), rows
    from the top; equal depths go to the least gid. Points behind the eye, out of the picture or without coordinates
    aren't shown."""
    rows = _shown(cloud.select("gid", "x", "y", "z"), view, width, height)
    best = rows.groupBy("px", "py").agg(F.min(F.struct("depth", "gid")).alias("b"))
    return best.select("px", "py", "b.gid", "b.depth")


def pick(cloud: DataFrame, px: int, py: int, view: np.ndarray, width: int, height: int, reach: int = 0) -> DataFrame:
    """(gid, x, y, z, depth): what ``perspective_view`` shows in a pixel, or in the nearest one within ``reach`` that shows
    anything; no row if none does. Only points of those pixels are compared."""
    u, v = F.col("px") - px, F.col("py") - py
    near = _shown(cloud.select("gid", "x", "y", "z"), view, width, height).where((F.abs(u) <= reach) & (F.abs(v) <= reach))
    best = near.agg(F.min(F.struct((u * u + v * v).alias("away"), "depth", "gid", "x", "y", "z")).alias("b"))
    return best.where("b is not null").select("b.gid", "b.x", "b.y", "b.z", "b.depth")
