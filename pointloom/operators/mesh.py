"""Triangle meshes as two tables, vertices (vid, x, y, z) and triangles (tid, a, b, c); surfaces from points."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.columns import cell, true_sum
from pointloom.plans.lineage import cut
from pointloom.plans.prefix import running_total

LAMBDA, MU = 0.5, -0.53
#: Places of one triangle that go out at once, and points up to which a sample is broadcast to the vertices.
PLACES, FEW = 65_536, 100_000


def corners(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Triangles with their corners' coordinates: ax, ay, az to cz.

    Joins are told to merge: where vertices come out of an ``explode``, Spark guesses their size from the rows before it and
    would broadcast a whole mesh."""
    out = triangles.select("tid", "a", "b", "c")
    for k in "abc":
        out = out.join(vertices.select(F.col("vid").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "xyz"]).hint("merge"), k)
    return out


def face_normal() -> list[Column]:
    """Twice the area vector of a row of ``corners``."""
    ab, ac = ([F.col(f"{k}{c}") - F.col(f"a{c}") for c in "xyz"] for k in "bc")
    return [ab[1] * ac[2] - ab[2] * ac[1], ab[2] * ac[0] - ab[0] * ac[2], ab[0] * ac[1] - ab[1] * ac[0]]


def _length(v: list[Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def edges(triangles: DataFrame) -> DataFrame:
    """(p, q, uses): each edge once, lower end first, with the number of triangles on it."""
    pair = lambda s, t: F.struct(F.least(s, t).alias("p"), F.greatest(s, t).alias("q"))
    return triangles.select(F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"))).alias("e")).groupBy("e.p", "e.q").agg(F.count("*").alias("uses"))


def measure(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """One row: triangles, area, volume, degenerate triangles, boundary and shared-by-many edges, whether it is closed."""
    full, n = corners(vertices, triangles), face_normal()
    signed = (F.col("ax") * n[0] + F.col("ay") * n[1] + F.col("az") * n[2]) / 6.0
    whole = full.agg(F.count("*").alias("triangles"), (true_sum(_length(n)) / 2.0).alias("area"), F.abs(true_sum(signed)).alias("volume"), F.sum(F.when(_length(n) / 2.0 < 1e-18, 1).otherwise(0)).alias("degenerate"))
    uses = edges(triangles).agg(F.sum(F.when(F.col("uses") == 1, 1).otherwise(0)).alias("boundary_edges"), F.sum(F.when(F.col("uses") > 2, 1).otherwise(0)).alias("manifold_breaks"))
    return whole.join(F.broadcast(uses)).withColumn("closed", (F.col("boundary_edges") == 0) & (F.col("manifold_breaks") == 0))  # one row each


def boundary(triangles: DataFrame) -> DataFrame:
    return edges(triangles).where("uses = 1").select("p", "q")


def vertex_normals(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(vid, nx, ny, nz): the area-weighted mean of the faces round a vertex."""
    n = face_normal()
    each = corners(vertices, triangles).select(F.explode(F.array("a", "b", "c")).alias("vid"), *[v.alias(f"n{c}") for c, v in zip("xyz", n, strict=True)])
    sums = each.groupBy("vid").agg(*[F.sum(f"n{c}").alias(f"_{c}") for c in "xyz"])
    size = F.nullif(_length([F.col(f"_{c}") for c in "xyz"]), F.lit(0.0))
    return sums.select("vid", *[(F.col(f"_{c}") / size).alias(f"n{c}") for c in "xyz"])


def flip(triangles: DataFrame) -> DataFrame:
    return triangles.select("tid", "a", F.col("c").alias("b"), F.col("b").alias("c"))


def smooth(vertices: DataFrame, triangles: DataFrame, passes: int = 5, taubin: bool = True, pin: bool = True) -> DataFrame:
    """Moves vertices toward the mean of their neighbours, and with ``taubin`` back again; boundary vertices stay if pinned."""
    sides = cut(edges(triangles))
    both = cut(sides.select("p", "q").unionAll(sides.select(F.col("q").alias("p"), F.col("p").alias("q"))))
    fixed = sides.where("uses = 1").select(F.explode(F.array("p", "q")).alias("vid")).distinct().withColumn("_pin", F.lit(True))
    now, rest = vertices.select("vid", "x", "y", "z"), [c for c in vertices.columns if c not in "xyz"]
    for k in range(passes):
        for factor in (LAMBDA, MU) if taubin else (LAMBDA,):
            mean = both.join(now.withColumnRenamed("vid", "q"), "q").groupBy(F.col("p").alias("vid")).agg(*[F.avg(c).alias(f"_{c}") for c in "xyz"])
            moved = now.join(mean, "vid", "left").join(fixed, "vid", "left")
            held = F.coalesce(F.col("_pin"), F.lit(False)) if pin else F.lit(False)
            now = moved.select("vid", *[F.when(held, F.col(c)).otherwise(F.col(c) + (F.coalesce(f"_{c}", c) - F.col(c)) * factor).alias(c) for c in "xyz"])
        now = cut(now) if k % 2 else now
    return vertices.select(rest).join(now, "vid")


def decimate(vertices: DataFrame, triangles: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Clusters vertices by cell: one vertex for each, at the least of its planes' squared distances if that lies within
    three quarters of a cell of their area-weighted mean, else at the mean. Collapsed and repeated triangles go."""
    key = [cell(F.col(c), size).alias(f"k{c}") for c in "xyz"]
    where = vertices.select("vid", F.struct(*key).alias("k"))
    cells = cut(where.groupBy("k").agg(F.min("vid").alias("cid")))
    owner = cut(where.join(cells, "k").select("vid", "cid"))
    n, full = face_normal(), corners(vertices, triangles)
    area = _length(n) / 2.0
    unit = [v / F.nullif(_length(n), F.lit(0.0)) for v in n]
    planes = full.select(F.explode(F.array(*[F.struct(F.col(k).alias("vid"), *[F.col(f"{k}{c}").alias(c) for c in "xyz"]) for k in "abc"])).alias("p"), area.alias("w"), *[F.coalesce(u, F.lit(0.0)).alias(f"n{c}") for c, u in zip("xyz", unit, strict=True)])
    planes = planes.select("p.*", "w", "nx", "ny", "nz").join(owner, "vid")
    offset = F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z")
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    sums = planes.groupBy("cid").agg(F.sum("w").alias("w"), *[(F.sum(F.col("w") * F.col(c)) / F.nullif(F.sum("w"), F.lit(0.0))).alias(f"m{c}") for c in "xyz"], *[F.sum(F.col("w") * F.col(f"n{a}") * F.col(f"n{b}")).alias(f"q{a}{b}") for a, b in pairs], *[F.sum(F.col("w") * F.col(f"n{c}") * offset).alias(f"d{c}") for c in "xyz"])
    q = lambda a, b: F.col("q" + "".join(sorted(a + b)))

    def det(rows) -> Column:
        (a, b, c), (d, e, f), (g, h, i) = rows
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    grid = [[q(a, b) for b in "xyz"] for a in "xyz"]
    whole = det(grid)
    steep = F.abs(whole) > F.pow(F.col("w"), F.lit(3.0)) * 1e-8
    solved = []
    for k in range(3):
        column = [[F.col(f"d{'xyz'[r]}") if c == k else grid[r][c] for c in range(3)] for r in range(3)]
        solved.append(F.when(steep, det(column) / F.nullif(whole, F.lit(0.0))))
    away = _length([s - F.col(f"m{c}") for s, c in zip(solved, "xyz", strict=True)])
    near = F.coalesce(away <= size * 0.75, F.lit(False))
    placed = sums.select("cid", *[F.when(near, s).otherwise(F.col(f"m{c}")).alias(c) for s, c in zip(solved, "xyz", strict=True)])
    plain = vertices.join(owner, "vid").groupBy("cid").agg(*[F.avg(c).alias(f"_{c}") for c in "xyz"])
    out = plain.join(placed, "cid", "left").select(F.col("cid").alias("vid"), *[F.coalesce(c, f"_{c}").alias(c) for c in "xyz"])
    tri = triangles
    for k in "abc":
        tri = tri.join(owner.select(F.col("vid").alias(k), F.col("cid").alias(f"_{k}")), k)
    tri = tri.where("_a <> _b and _b <> _c and _c <> _a").select("tid", F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_c").alias("c"))
    tri = tri.groupBy(F.array_sort(F.array("a", "b", "c")).alias("s")).agg(F.min(F.struct("tid", "a", "b", "c")).alias("t")).select("t.*")
    return out, tri


def sample(vertices: DataFrame, triangles: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """(gid, x, y, z, and normals and colours where the vertices have them): ``count`` points spread by area.

    The k-th point stands at a chance place in the k-th of ``count`` equal shares of the running area. A triangle knows from
    where to where it reaches and works out by itself which places fall into it, so shares and triangles need not meet."""
    full, n = corners(vertices, triangles), face_normal()
    areas = cut(full.select("tid", "a", "b", "c", (_length(n) / 2.0).alias("area")).where("area > 0 and area < double('infinity')"))
    spans = running_total(areas, "tid", "area", "to", start="from")
    whole = areas.agg(true_sum(F.col("area")).alias("whole")).first()["whole"] or 0.0
    carried = [c for c in ("nx", "ny", "nz", "r", "g", "b") if c in vertices.columns]
    chance = lambda tag: F.pmod(F.xxhash64("gid", F.lit(f"{seed}{tag}")), F.lit(1 << 52)) / float(1 << 52)
    share = whole / max(1, count) or 1.0
    held = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(count - 1)).cast("long")
    spans = spans.withColumns({"_first": held(F.floor(F.col("from") / share) - 1), "_last": held(F.floor(F.col("to") / share) + 1)})
    # A large triangle's places go out some at a time.
    spans = spans.where(F.lit(count > 0)).withColumn("_some", F.explode(F.sequence("_first", "_last", F.lit(PLACES).cast("long"))))
    draws = spans.withColumn("gid", F.explode(F.sequence("_some", F.least(F.col("_some") + (PLACES - 1), F.col("_last")))))
    at = F.least((F.col("gid") + chance("a")) * share, F.lit(math.nextafter(whole, 0.0)))
    hit = draws.where((at >= F.col("from")) & (at < F.col("to")))
    if count <= FEW:
        corner = cut(hit.select("gid", "a", "b", "c"))
        for k in "abc":
            own = vertices.select(F.col("vid").alias(k), F.struct("x", "y", "z", *carried).alias(f"_{k}"))
            corner = own.join(F.broadcast(corner), k)  # at most FEW rows
    else:
        each = hit.select("gid", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("vid")) for k in "abc"])).alias("e")).select("gid", "e.k", "e.vid")
        each = each.join(vertices.select("vid", F.struct("x", "y", "z", *carried).alias("v")).hint("merge"), "vid")
        corner = each.groupBy("gid").agg(*[F.first(F.when(F.col("k") == k, F.col("v")), ignorenulls=True).alias(f"_{k}") for k in "abc"])
    root, t = F.sqrt(chance("r")), chance("t")

    def mixed(name: str) -> Column:
        a, b, c = (F.col(f"_{k}.{name}") for k in "abc")
        inside = a + root * ((b - a) * (F.lit(1.0) - t) + (c - a) * t)
        return F.least(F.greatest(inside, F.least(a, b, c)), F.greatest(a, b, c))  # rounding never leaves the triangle's box

    out = corner.select("gid", *[mixed(c).alias(c) for c in ("x", "y", "z", *carried)])
    if "nx" in carried:
        length = F.nullif(F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")), F.lit(0.0))
        out = out.select(*[(F.col(c) / length).alias(c) if c in ("nx", "ny", "nz") else F.col(c) for c in out.columns])
    return out.select(*[F.round(c).cast("int").alias(c) if c in ("r", "g", "b") else F.col(c) for c in out.columns])


def cumulative_area(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(tid, area, total): running area in the order of tid."""
    full, n = corners(vertices, triangles), face_normal()
    return running_total(full.select("tid", (_length(n) / 2.0).alias("area")), "tid", "area", "total").select("tid", "area", "total")


def tsdf(cloud: DataFrame, voxel: float, reach: float = 2.0) -> DataFrame:
    """(gx, gy, gz, dist, weight): each point walks its normal ``reach`` voxels either way and leaves signed distances at
    the eight corners around each step; corners take the weighted mean. Sums are combined before the shuffle."""
    trunc = max(reach, 0.75) * voxel
    steps = int(trunc / voxel + 0.5)
    t = F.explode(F.array(*[F.lit(k * voxel) for k in range(-steps, steps + 1)]))
    walk = cloud.where("nx is not null").select("x", "y", "z", "nx", "ny", "nz", t.alias("t"))
    at = {c: (F.col(c) + F.col(f"n{c}") * F.col("t")) / voxel for c in "xyz"}
    walk = walk.select("t", *[a.alias(c) for c, a in at.items()])
    bits = F.explode(F.array(*[F.struct(*[F.lit(b).alias(c) for c, b in zip("xyz", bs, strict=True)]) for bs in [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]]))
    each = walk.select("t", "x", "y", "z", bits.alias("b"))
    share = reduce(lambda a, b: a * b, [F.when(F.col(f"b.{c}") == 1, F.col(c) - F.floor(c)).otherwise(F.lit(1.0) - F.col(c) + F.floor(c)) for c in "xyz"])
    weight = share * (F.lit(1.0) - F.abs("t") / trunc * 0.75)
    each = each.select(*[(F.floor(c) + F.col(f"b.{c}")).cast("long").alias(f"g{c}") for c in "xyz"], F.col("t"), weight.alias("w"))
    sums = each.groupBy("gx", "gy", "gz").agg(F.sum(F.col("t") * F.col("w")).alias("s"), F.sum("w").alias("weight"))
    return sums.select("gx", "gy", "gz", (F.col("s") / F.nullif(F.col("weight"), F.lit(0.0))).alias("dist"), "weight")


def density(cloud: DataFrame, voxel: float, iso: float = 0.5) -> DataFrame:
    """(gx, gy, gz, dist, weight) for points without normals: each weighs on the corners around it, and the surface is
    where the weight falls to ``iso``. Voxels beside a weighted one that have none themselves are outside."""
    at = {c: F.col(c) / voxel for c in "xyz"}
    bits = F.explode(F.array(*[F.struct(*[F.lit(b).alias(c) for c, b in zip("xyz", bs, strict=True)]) for bs in [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]]))
    each = cloud.select(*[a.alias(c) for c, a in at.items()]).select("x", "y", "z", bits.alias("b"))
    share = reduce(lambda a, b: a * b, [F.when(F.col(f"b.{c}") == 1, F.col(c) - F.floor(c)).otherwise(F.lit(1.0) - F.col(c) + F.floor(c)) for c in "xyz"])
    weights = each.groupBy(*[(F.floor(c) + F.col(f"b.{c}")).cast("long").alias(f"g{c}") for c in "xyz"]).agg(F.sum(share).alias("weight"))
    around = weights.select("gx", "gy", "gz", F.lit(0.0).alias("weight"))
    for c in "xyz":
        around = around.withColumn(f"g{c}", F.explode(F.array(*[F.col(f"g{c}") + k for k in (-1, 0, 1)])))
    full = weights.unionAll(around.select("gx", "gy", "gz", "weight")).groupBy("gx", "gy", "gz").agg(F.max("weight").alias("weight"))
    return full.select("gx", "gy", "gz", (F.lit(max(iso, 0.001)) - F.col("weight")).alias("dist"), "weight")


def surface_nets(field: DataFrame, voxel: float, least: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles): a vertex at the mean of the edge crossings of each cell whose eight corners are known and
    differ in sign, and two triangles for each crossed edge whose four cells have one. Corners meet by group-by."""
    known = cut(field.where((F.col("weight") >= least) & F.col("dist").isNotNull()).select("gx", "gy", "gz", "dist"))
    offsets = [(i, j, k) for k in (0, 1) for j in (0, 1) for i in (0, 1)]
    move = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(v).alias(c) for c, v in zip("xyz", o, strict=True)]) for n, o in enumerate(offsets)]))
    spread = known.select("gx", "gy", "gz", "dist", move.alias("m")).select(*[(F.col(f"g{c}") - F.col(f"m.{c}")).alias(f"g{c}") for c in "xyz"], F.col("m.n").alias("n"), "dist")
    cells = spread.groupBy("gx", "gy", "gz").agg(F.count("*").alias("all"), *[F.max(F.when(F.col("n") == n, F.col("dist"))).alias(f"d{n}") for n in range(8)]).where("all = 8")
    lo, hi = F.least(*[F.col(f"d{n}") for n in range(8)]), F.greatest(*[F.col(f"d{n}") for n in range(8)])
    cells = cells.where((lo < 0) & (hi >= 0))
    crossings = []
    for p in range(8):
        for q in range(p + 1, 8):
            if sum(a != b for a, b in zip(offsets[p], offsets[q], strict=True)) == 1:
                hit = (F.col(f"d{p}") < 0) != (F.col(f"d{q}") < 0)
                s = F.col(f"d{p}") / F.nullif(F.col(f"d{p}") - F.col(f"d{q}"), F.lit(0.0))
                crossings.append((hit, [F.lit(float(a)) + s * float(b - a) for a, b in zip(offsets[p], offsets[q], strict=True)]))
    count = reduce(lambda a, b: a + b, [F.when(h, 1).otherwise(0) for h, _ in crossings])
    mean = [reduce(lambda a, b: a + b, [F.when(h, v[k]).otherwise(0.0) for h, v in crossings]) / count for k in range(3)]
    placed = cells.select("gx", "gy", "gz", *[((F.col(f"g{c}") + m) * voxel).alias(c) for c, m in zip("xyz", mean, strict=True)])
    vertices = cut(placed.withColumn("vid", F.monotonically_increasing_id()))
    quads = None
    for k, axis in enumerate("xyz"):
        ahead = known.select(*[(F.col(f"g{c}") - F.lit(int(c == axis))).alias(f"g{c}") for c in "xyz"], F.col("dist").alias("next"))
        signs = known.join(ahead, ["gx", "gy", "gz"]).where((F.col("dist") < 0) != (F.col("next") < 0)).select("gx", "gy", "gz", (F.col("dist") < 0).alias("out"))
        u, v = "xyz"[(k + 1) % 3], "xyz"[(k + 2) % 3]
        around = [(0, 0), (-1, 0), (-1, -1), (0, -1)]
        quad = signs
        for n, (i, j) in enumerate(around):
            ids = vertices.select(*[(F.col(f"g{c}") - F.lit(i if c == u else j if c == v else 0)).alias(f"g{c}") for c in "xyz"], F.col("vid").alias(f"q{n}"))
            quad = quad.join(ids, ["gx", "gy", "gz"])
        quads = quad if quads is None else quads.unionAll(quad)
    turn = lambda *names: F.struct(*[F.col(n).alias(k) for n, k in zip(names, "abc", strict=True)])
    pair = F.when(F.col("out"), F.array(turn("q0", "q1", "q2"), turn("q0", "q2", "q3"))).otherwise(F.array(turn("q0", "q2", "q1"), turn("q0", "q3", "q2")))
    triangles = quads.select(F.explode(pair).alias("t")).select("t.*").withColumn("tid", F.monotonically_increasing_id())
    return vertices.select("vid", "x", "y", "z"), triangles.select("tid", "a", "b", "c")


def build_surface(cloud: DataFrame, voxel: float = 0.06, smoothing: int = 2, least: float = 0.15, iso: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles). Where most points have no normal (four to one), the surface is that of their density."""
    share = cloud.agg(F.count("nx").alias("with"), F.count("*").alias("all")).first() if "nx" in cloud.columns else {"with": 0, "all": 1}
    if share["with"] * 4 < share["all"] - share["with"]:
        field, least = density(cloud, voxel, iso), 0.0
    else:
        field = tsdf(cloud, voxel)
    vertices, triangles = surface_nets(field, voxel, least)
    triangles = cut(triangles)
    return smooth(vertices, triangles, smoothing, pin=False) if smoothing else vertices, triangles


#: Fixed value: the share of boundary edges to triangles from which a surface is too open to measure.
OPEN = 0.2


def recommended_source(measured: dict | None, from_normals: bool) -> dict:
    """(source, reason, holeRatio): ``mesh`` where no rule of the table speaks against it, else ``points`` and the first that does."""
    found = measured or {}
    ratio = found.get("boundary_edges", 0) / found["triangles"] if found.get("triangles") else 1.0
    rules = {"no_surface": not found, "no_normals": not from_normals, "open": ratio >= OPEN}
    against = [code for code, holds in rules.items() if holds]
    return {"source": "points" if against else "mesh", "reason": against[0] if against else "closed", "holeRatio": ratio if found else None}
