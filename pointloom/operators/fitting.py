"""Fits and registration: each step is one aggregate of sums over the cloud and a small solve where the query is planned."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.matrix import scaling, translation
from pointloom.operators.neighbours import Written, nearest_faced
from pointloom.operators.tiles import Tiled, bucketed, places
from pointloom.plans.lineage import cut, discard

PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def _moments(cloud: DataFrame, columns: str = "xyz", prefix: str = "") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance) in two passes: the second sums offsets from the mean."""
    names = [f"{prefix}{c}" for c in columns]
    first = cloud.agg(F.count("*").alias("n"), *[F.avg(n).alias(n) for n in names]).first()
    if not first["n"]:
        return 0, np.zeros(len(names)), np.zeros((len(names),) * 2)
    mean = [float(first[n]) for n in names]
    d = [F.col(n) - m for n, m in zip(names, mean, strict=True)]
    row = cloud.agg(*[F.avg(d[i] * d[j]) for i in range(len(d)) for j in range(len(d))]).first()
    return first["n"], np.array(mean), np.array([float(v) for v in row]).reshape(len(d), len(d))


def _residuals(cloud: DataFrame, distance) -> tuple[float, float]:
    r = cloud.agg(F.sqrt(F.avg(distance * distance)), F.max(F.abs(distance))).first()
    return float(r[0] or 0), float(r[1] or 0)


def fit_plane(cloud: DataFrame) -> dict:
    """Least squares; the normal looks up."""
    n, mean, cov = _moments(cloud)
    normal = np.linalg.eigh(cov)[1][:, 0]
    normal = normal if normal[2] >= 0 else -normal
    d = sum(((F.col(c) - float(m)) * float(v) for c, m, v in zip("yz", mean[1:], normal[1:], strict=True)), (F.col("x") - float(mean[0])) * float(normal[0]))
    rms, worst = _residuals(cloud, d)
    steep = float(np.degrees(np.arccos(min(1.0, abs(normal[2])))))
    toward = float(np.degrees(np.arctan2(-normal[0], -normal[1])) % 360) if steep >= 0.01 else 0.0
    kind = "horizontal" if steep < 5 else "vertical" if steep > 85 else "inclined"
    return {"kind": "plane", "center": mean.tolist(), "normal": normal.tolist(), "rms": rms, "worst": worst, "points": n, "dip": steep, "dip_direction": toward, "orientation": kind}


def _ball(cloud: DataFrame, names: list[str], rounds: int) -> tuple[np.ndarray, float]:
    """Centre and radius in any dimension: the algebraic fit, then Gauss-Newton on distances."""
    mean = np.array([float(v) for v in cloud.agg(*[F.avg(n) for n in names]).first()])
    d = [F.col(n) - float(m) for n, m in zip(names, mean, strict=True)]
    s = sum((v * v for v in d[1:]), d[0] * d[0])
    terms = [*d, F.lit(1.0)]
    k = len(terms)
    row = [float(v) for v in cloud.agg(*[F.sum(a * b) for a in terms for b in terms], *[F.sum(s * a) for a in terms]).first()]
    solved = np.linalg.solve(np.array(row[: k * k]).reshape(k, k) + 1e-12 * np.eye(k), np.array(row[k * k :]))
    centre = solved[:-1] / 2
    radius = float(np.sqrt(max(solved[-1] + centre @ centre, 0)))
    for _ in range(rounds):
        o = [v - float(c) for v, c in zip(d, centre, strict=True)]
        far = F.sqrt(sum((v * v for v in o[1:]), o[0] * o[0]))
        g = [-(v / F.nullif(far, F.lit(0.0))) for v in o] + [F.lit(-1.0)]
        row = [float(v or 0) for v in cloud.agg(*[F.sum(a * b) for a in g for b in g], *[F.sum(a * (far - radius)) for a in g]).first()]
        step = np.linalg.solve(np.array(row[: k * k]).reshape(k, k) + 1e-12 * np.eye(k), -np.array(row[k * k :]))
        centre, radius = centre + step[:-1], radius + float(step[-1])
        if np.abs(step).max() < 1e-9:
            break
    return centre + mean, radius


def fit_sphere(cloud: DataFrame, rounds: int = 12) -> dict:
    centre, radius = _ball(cloud, ["x", "y", "z"], rounds)
    o = [F.col(c) - float(v) for c, v in zip("xyz", centre, strict=True)]
    rms, worst = _residuals(cloud, F.sqrt(o[0] * o[0] + o[1] * o[1] + o[2] * o[2]) - radius)
    return {"kind": "sphere", "center": centre.tolist(), "radius": radius, "rms": rms, "worst": worst, "points": cloud.count()}


def _across(axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = np.cross(axis, np.eye(3)[np.argmin(np.abs(axis))])
    u /= np.linalg.norm(u)
    return u, np.cross(axis, u)


def _flat(cloud: DataFrame, centre: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> DataFrame:
    d = [F.col(c) - float(m) for c, m in zip("xyz", centre, strict=True)]
    return cloud.select(*[(d[0] * float(a[0]) + d[1] * float(a[1]) + d[2] * float(a[2])).alias(n) for n, a in (("u", u), ("v", v), ("w", w))])


def fit_cylinder(cloud: DataFrame, rounds: int = 10) -> dict:
    """The axis is what normals have least of; a circle across it gives the rest."""
    row = cloud.agg(*[F.avg(F.col(f"n{a}") * F.col(f"n{b}")) for a in "xyz" for b in "xyz"]).first()
    axis = np.linalg.eigh(np.array([float(v) for v in row]).reshape(3, 3))[1][:, 0]
    axis = axis if axis[2] >= 0 else -axis
    _, mean, _ = _moments(cloud)
    u, v = _across(axis)
    flat = _flat(cloud, mean, u, v, axis)
    c, radius = _ball(flat, ["u", "v"], rounds)
    o = [F.col("u") - float(c[0]), F.col("v") - float(c[1])]
    rms, worst = _residuals(flat, F.sqrt(o[0] * o[0] + o[1] * o[1]) - radius)
    ends = flat.agg(F.min("w"), F.max("w")).first()
    middle = (ends[0] + ends[1]) / 2
    return {"kind": "cylinder", "center": (mean + c[0] * u + c[1] * v + middle * axis).tolist(), "axis": axis.tolist(), "radius": radius, "length": ends[1] - ends[0], "rms": rms, "worst": worst, "points": cloud.count()}


def fit_circle(cloud: DataFrame) -> dict:
    """A plane, then a circle in it; residuals are in space."""
    plane = fit_plane(cloud)
    normal, mean = np.array(plane["normal"]), np.array(plane["center"])
    u, v = _across(normal)
    flat = _flat(cloud, mean, u, v, normal)
    c, radius = _ball(flat, ["u", "v"], 0)
    o = [F.col("u") - float(c[0]), F.col("v") - float(c[1])]
    off = F.sqrt(o[0] * o[0] + o[1] * o[1]) - radius
    rms, worst = _residuals(flat, F.sqrt(off * off + F.col("w") * F.col("w")))
    return {"kind": "circle", "center": (mean + c[0] * u + c[1] * v).tolist(), "normal": normal.tolist(), "radius": radius, "rms": rms, "worst": worst, "points": plane["points"]}


FITS = {"plane": fit_plane, "sphere": fit_sphere, "cylinder": fit_cylinder, "circle": fit_circle}


def _candidate(kind: str, p: np.ndarray, n: np.ndarray) -> tuple | None:
    """A shape through a minimal sample: (point or centre, direction, radius)."""
    if kind == "plane":
        d = np.cross(p[1] - p[0], p[2] - p[0])
        return (p[0], d / np.linalg.norm(d), 0.0) if np.linalg.norm(d) > 1e-12 else None
    if kind == "sphere":
        a = np.column_stack([2 * p[:4], np.ones(4)])
        if abs(np.linalg.det(a)) < 1e-12:
            return None
        s = np.linalg.solve(a, (p[:4] ** 2).sum(1))
        return s[:3], np.zeros(3), float(np.sqrt(max(s[3] + s[:3] @ s[:3], 0)))
    axis = np.cross(n[0], n[1])
    if np.linalg.norm(axis) < 1e-6:
        return None
    axis /= np.linalg.norm(axis)
    u, v = _across(axis)
    q, m = np.column_stack([p @ u, p @ v]), np.column_stack([n @ u, n @ v])
    a = np.column_stack([m[0], -m[1]])
    if abs(np.linalg.det(a)) < 1e-6:
        return None
    c = q[0] + m[0] * np.linalg.solve(a, q[1] - q[0])[0]
    return c[0] * u + c[1] * v, axis, float(np.linalg.norm(q[0] - c))


def _off(kind: str, shape: tuple):
    c, a, r = shape
    d = [F.col(k) - float(v) for k, v in zip("xyz", c, strict=True)]
    along = d[0] * float(a[0]) + d[1] * float(a[1]) + d[2] * float(a[2])
    square = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    if kind == "plane":
        return F.abs(along)
    return F.abs(F.sqrt(F.greatest(square - along * along if kind == "cylinder" else square, F.lit(0.0))) - r)


#: Minimal samples of each kind in a tile, shapes of each kind that a tile proposes, shapes that are scored over the whole cloud in a round,
#: the least points that speak for a proposal in its tile, and the largest radius of a shape.
TRIALS, PROPOSED, SCORED, SPOKEN, WIDEST = 160, 4, 256, 24, 1e3
_SHAPE = "kind string, cx double, cy double, cz double, ax double, ay double, az double, r double"


def _far(kinds: np.ndarray, shapes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How far each place (row) is from each shape's surface (column). ``shapes``: centre, axis, radius; a plane's axis is its normal."""
    out = np.empty((len(p), len(shapes)))
    for kind in np.unique(kinds):
        ids = np.flatnonzero(kinds == kind)
        c, a, r = shapes[ids, :3], shapes[ids, 3:6], shapes[ids, 6]
        d = p[:, None] - c
        along = (d * a).sum(axis=2)
        if kind == "plane":
            out[:, ids] = np.abs(along)
        else:
            square = (d * d).sum(axis=2)
            out[:, ids] = np.abs(np.sqrt(np.maximum(square - along * along if kind == "cylinder" else square, 0)) - r)
    return out


def _refined(kind: str, shape: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A plane or a sphere through all of its points, by least squares; a cylinder as it is."""
    middle = own.mean(axis=0)
    if kind == "plane":
        return np.array([*middle, *np.linalg.svd(own - middle, full_matrices=False)[2][2], 0.0])
    if kind == "sphere":
        q = own - middle
        s = np.linalg.lstsq(np.column_stack([2 * q, np.ones(len(q))]), (q * q).sum(axis=1), rcond=None)[0]
        return np.array([*(s[:3] + middle), 0, 0, 0, np.sqrt(max(s[3] + s[:3] @ s[:3], 0.0))])
    return shape


def _proposals(p: np.ndarray, n: np.ndarray, kinds: tuple, tolerance: float, trials: int, rng: np.random.Generator) -> list[tuple[str, np.ndarray, int]]:
    """(kind, shape, points) of one tile: minimal samples from neighbourhoods of every size, best supported in the tile first,
    each counted without the points of those before."""
    order, _ = bucketed(p)  # runs of this order are neighbourhoods
    sizes = 2 ** rng.integers(3, max(4, int(np.log2(len(p))) + 1), trials * len(kinds))
    names, shapes = [], []
    for k, size in enumerate(np.minimum(sizes, len(p))):
        kind, start = kinds[k % len(kinds)], int(rng.integers(0, len(p) - size + 1))
        rows = order[start + rng.choice(size, min(4, size), replace=False)]
        found = _candidate(kind, p[rows], n[rows]) if len(rows) == 4 else None
        if found is not None and (kind == "plane" or 2 * tolerance < found[2] < WIDEST) and np.isfinite(np.concatenate([*found[:2], [found[2]]])).all():
            names.append(kind)
            shapes.append(np.array([*found[0], *found[1], found[2]]))
    if not shapes:
        return []
    names, shapes = np.array(names), np.array(shapes)
    near = np.concatenate([_far(names, shapes, p[k : k + 1024]) <= tolerance for k in range(0, len(p), 1024)])
    out = []
    for kind in kinds:  # each by itself: a wide ball may take a wall's patch, but not its place among the proposals
        own_kind, left = np.flatnonzero(names == kind), np.ones(len(p), bool)
        for _ in range(PROPOSED if len(own_kind) else 0):
            counts = near[np.ix_(left, own_kind)].sum(axis=0)
            best = int(own_kind[counts.argmax()])
            if counts.max() < SPOKEN:
                break
            own = near[:, best] & left
            better = _refined(kind, shapes[best], p[own])
            sound = kind == "plane" or 2 * tolerance < better[6] < WIDEST
            with_it = int((_far(names[[best]], better[None], p[left])[:, 0] <= tolerance).sum()) if sound else 0
            out.append((kind, better if with_it >= counts.max() else shapes[best], max(with_it, int(counts.max()))))
            left &= ~own
    return out


def _passes(kinds: np.ndarray, shapes: np.ndarray, lo: np.ndarray, hi: np.ndarray, tolerance: float) -> np.ndarray:
    """Whether a shape's surface can come within ``tolerance`` of a place in a box: by the ball around the box."""
    middle = (lo + hi) / 2
    return _far(kinds, shapes, middle[None])[0] <= tolerance + float(np.linalg.norm(hi - lo)) / 2 * (1 + 1e-9)


def detect(cloud: DataFrame, tolerance: float = 0.02, least: int = 2000, most: int = 12, kinds=("plane", "sphere", "cylinder"), trials: int = TRIALS, seed: int = 7) -> list[dict]:
    """Shapes, best supported first; a shape's points leave the cloud before the next is sought. Radii stay over two tolerances.

    Every tile of the cloud proposes what its own points speak for, from ``trials`` minimal samples of each kind whatever the cloud's size; so
    a round's work is linear in the points. Of proposals that are alike one goes on, and the SCORED best supported, summed over
    tiles, are counted over the whole cloud, in each tile only those whose surface passes its box. The driver holds SCORED shapes.
    A shape of ``least`` points is proposed where it is SPOKEN points of some tile's neighbourhoods; others may be missed."""
    tiled, found = Tiled(cloud), []
    plan, kinds = tiled.plan, tuple(kinds)
    columns = ["gid", "x", "y", "z", "nx", "ny", "nz"]
    lows = [float(v or 0.0) for v in cloud.agg(*[F.min(c) for c in "xyz"]).first()]
    rows = cloud.select(F.col("gid").cast("long").alias("gid"), *[F.col(c).cast("double").alias(c) for c in columns[1:]])

    def deal(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(plan.home(places(batch, 1))), *batch.columns], names=["tile", *columns])

    left = cut(rows.where("x is not null and y is not null and z is not null").mapInArrow(deal, "tile long, gid long, " + ", ".join(f"{c} double" for c in columns[1:])))
    tasks = max(int(tiled.spark.conf.get("spark.sql.shuffle.partitions")), 2**plan.depth // 8)

    def by_tile(answer, schema):
        """Tiles of what is left, one after another; a task holds one."""

        def run(batches):
            key, held = None, []

            def close():
                table = pa.Table.from_batches(held)
                yield from answer(int(key), np.stack([table.column(c).to_numpy() for c in columns[1:]], axis=1).astype(float))

            for batch in batches:
                tile = batch.column(0).to_numpy()
                turns = np.flatnonzero(np.diff(tile)) + 1
                for a, b in zip([0, *turns], [*turns, len(tile)], strict=True):
                    if a < b and tile[a] != key:
                        if held:
                            yield from close()
                        key, held = tile[a], []
                    if a < b:
                        held.append(batch.slice(a, b - a))
            if held:
                yield from close()

        return left.repartition(min(tasks, 2**plan.depth), "tile").sortWithinPartitions("tile", "gid").mapInArrow(run, schema)

    def propose(tile, rows):
        rng = np.random.default_rng([seed, len(found), tile])
        made = _proposals(rows[:, :3] - lows, rows[:, 3:], kinds, tolerance, trials, rng) if len(rows) >= 4 else []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), *[pa.array([m[1][k] for m in made]) for k in range(7)], pa.array([m[2] for m in made])], names=["kind", "cx", "cy", "cz", "ax", "ay", "az", "r", "n"])

    while len(found) < most:
        made = cut(by_tile(propose, f"{_SHAPE}, n long"))
        # Alike: the same kind, with direction, place and radius within small steps; those that are right agree from tile to tile
        # and add up. A plane's place is how far along its normal it is.
        turn = F.when(F.coalesce(F.nullif(F.round(F.col("az"), 1), F.lit(0.0)), F.nullif(F.round(F.col("ay"), 1), F.lit(0.0)), F.col("ax")) < 0, -1.0).otherwise(1.0)
        along = F.col("cx") * F.col("ax") + F.col("cy") * F.col("ay") + F.col("cz") * F.col("az")
        place = [F.when(F.col("kind") == "plane", along * F.col(f"a{c}")).otherwise(F.col(f"c{c}") - (F.when(F.col("kind") == "cylinder", along).otherwise(0.0)) * F.col(f"a{c}")) for c in "xyz"]
        alike = [F.round(F.col(f"a{c}") * turn * 400).alias(f"_a{c}") for c in "xyz"] + [F.round(v / (2 * tolerance)).alias(f"_c{k}") for k, v in enumerate(place)] + [F.round(F.col("r") / (2 * tolerance)).alias("_r")]
        groups = made.groupBy("kind", *alike).agg(F.sum("n").alias("n"), F.max_by(F.struct("cx", "cy", "cz", "ax", "ay", "az", "r"), F.struct("n", "cx", "cy", "cz")).alias("s"))
        shapes = groups.select("kind", "s.*", "n").orderBy(F.desc("n"), "kind", "cx", "cy", "cz").limit(SCORED).collect()
        if not shapes:
            break
        names, values = np.array([s.kind for s in shapes]), np.array([[s[k] for k in range(1, 8)] for s in shapes])

        def score(tile, rows, names=names, values=values):
            p = rows[:, :3] - lows
            some = np.flatnonzero(_passes(names, values, p.min(axis=0), p.max(axis=0), tolerance))
            total = sum((_far(names[some], values[some], p[k : k + 1024]) <= tolerance).sum(axis=0) for k in range(0, len(p), 1024)) if len(some) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.asarray(total, np.int64))], names=["trial", "points"])

        sums = by_tile(score, "trial long, points long").groupBy("trial").agg(F.sum("points").alias("points")).orderBy(F.desc("points"), "trial").first()  # at most SCORED rows
        if sums is None or sums.points < least:
            break
        kind, best = names[sums.trial], values[sums.trial]
        off = _off(kind, (best[:3] + lows, best[3:6], best[6]))
        fit = FITS[kind](left.where(off <= tolerance))
        # What was fitted to all of its points may reach more of them than the sample that proposed it.
        again = _off(kind, (fit["center"], fit.get({"plane": "normal", "cylinder": "axis"}.get(kind)) or (0.0, 0.0, 0.0), fit.get("radius", 0.0)))
        if left.where(again <= tolerance).count() > sums.points:
            off, fit = again, FITS[kind](left.where(again <= tolerance))
        found.append(fit | {"shape": len(found)})
        after = cut(left.where(off > tolerance))
        discard(left, made)
        left = after
    return found


def label_shapes(cloud: DataFrame, shapes: list[dict], tolerance: float = 0.02) -> DataFrame:
    """(gid, shape): the nearest shape within ``tolerance``; of equals the later; null where none."""
    axis = {"plane": "normal", "cylinder": "axis", "sphere": None}
    offs = [_off(s["kind"], (s["center"], s.get(axis[s["kind"]]) or (0, 0, 0), s.get("radius", 0.0))) for s in shapes]
    if not offs:
        return cloud.select("gid", F.lit(None).cast("int").alias("shape"))
    best = F.array_max(F.array(*[F.struct((-o).alias("d"), F.lit(k).alias("k")) for k, o in enumerate(offs)]))
    return cloud.select("gid", F.when(best["d"] >= -tolerance, best["k"]).alias("shape"))


def match_centres(moving: DataFrame, fixed: DataFrame) -> np.ndarray:
    """The translation between the middles of the two boxes."""
    middle = lambda c: np.array([float(v) for v in c.agg(*[(F.min(a) + F.max(a)) / 2 for a in "xyz"]).first()])
    return translation(*(middle(fixed) - middle(moving)))


def match_scales(moving: DataFrame, fixed: DataFrame) -> float:
    """The mean ratio of the boxes' sides, over sides that have any length."""
    sides = lambda c: np.array([float(v) for v in c.agg(*[F.max(a) - F.min(a) for a in "xyz"]).first()])
    a, b = sides(moving), sides(fixed)
    good = (a > 1e-12) & (b > 1e-12)
    return float((b[good] / a[good]).mean()) if good.any() else 1.0


def level(cloud: DataFrame) -> np.ndarray:
    """Turns the cloud's plane flat about the middle of its box."""
    normal, up = np.array(fit_plane(cloud)["normal"]), np.array([0.0, 0.0, 1.0])
    middle = [float(v) for v in cloud.agg(*[(F.min(a) + F.max(a)) / 2 for a in "xyz"]).first()]
    axis = np.cross(normal, up)
    from pointloom.functions.matrix import rotation

    size = np.linalg.norm(axis)
    return rotation(axis, float(np.degrees(np.arctan2(size, normal @ up))), middle) if size > 1e-12 else scaling(1.0)


def icp(moving: DataFrame, fixed: DataFrame, reach: float, rounds: int = 30, sample: int = 200_000, least: int = 20) -> dict:
    """Point to plane: pairs within a gate that narrows to 15%, 27 sums an iteration, a small solve. ``fixed`` has normals.

    About ``sample`` points of the moving cloud, or all if it has no more, are held where the query is planned; the fixed
    cloud is written by tiles once and read in each round. A cloud of more points then meets the fixed one as a whole, where
    the last round left it: ``pairs``, ``rms`` and ``overlap`` are those of all its points."""
    n = moving.count()
    few = moving if n <= sample else moving.where(F.pmod(F.xxhash64("gid"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    rows = few.where("x is not null and y is not null and z is not null").select(F.col("gid").cast("long"), *[F.col(c).cast("double") for c in "xyz"]).toArrow()
    gid, start = rows.column(0).to_numpy(), np.stack([rows.column(c).to_numpy() for c in "xyz"], axis=1)
    whole = np.isfinite(start).all(axis=1)
    gid, start = gid[whole], start[whole]
    by = np.argsort(gid, kind="stable")
    gid, start = gid[by], start[by]
    written = Written(fixed, most=2 * sample)
    total, gate, history, pairs, tried, met = np.eye(4), reach, [], 0, 0, np.full((len(gid), 3), np.nan)
    for k in range(rounds):
        at = start @ total[:3, :3].T + total[:3, 3]
        mean = at.mean(axis=0).tolist() if len(at) else [0.0, 0.0, 0.0]
        # The point that a place met in the round before is still there: nothing farther can be its nearest. A little more, for rounding.
        near = cut(written.nearest(gid, at, gate, np.linalg.norm(met - at, axis=1) * (1 + 1e-9) + 1e-12 * (1 + np.abs(at).max(axis=1))))
        p, m = [F.col(c) - o for c, o in zip("xyz", mean, strict=True)], [F.col(f"n{c}") for c in "xyz"]
        g = [p[1] * m[2] - p[2] * m[1], p[2] * m[0] - p[0] * m[2], p[0] * m[1] - p[1] * m[0], *m]
        r = F.col("dx") * m[0] + F.col("dy") * m[1] + F.col("dz") * m[2]
        row = near.agg(F.count("*"), F.sum(r * r), *[F.sum(g[i] * g[j]) for i in range(6) for j in range(i, 6)], *[F.sum(a * r) for a in g]).first()
        pairs, tried = row[0], k + 1
        told = near.select("gid", *[F.col(c) + F.col(f"d{c}") for c in "xyz"]).toArrow()  # at most a row for each place that asks
        discard(near)
        if pairs < least:
            break
        met = np.full((len(gid), 3), np.nan)
        met[np.searchsorted(gid, told.column(0).to_numpy())] = np.stack([told.column(c).to_numpy() for c in (1, 2, 3)], axis=1)
        rms = float(np.sqrt(row[1] / pairs))
        a = np.zeros((6, 6))
        a[np.triu_indices(6)] = row[2:23]
        a = a + np.triu(a, 1).T
        step = np.linalg.solve(a + 1e-9 * np.trace(a) / 6 * np.eye(6), np.array(row[23:29], float))
        from pointloom.functions.matrix import rotation

        angle = float(np.linalg.norm(step[:3]))
        turn = rotation(step[:3], float(np.degrees(angle)), mean) if angle > 1e-15 else np.eye(4)
        total = translation(*step[3:]) @ turn @ total
        history.append(rms)
        if k >= 2 and history[-2] - rms < 1e-3 * history[-2]:
            break
        gate = max(gate * 0.85, reach * 0.15)
    sent = len(gid)
    if n > sample:
        at = {c: sum((F.col(b) * float(total[i, j]) for j, b in enumerate("xyz")), F.lit(float(total[i, 3]))) for i, c in enumerate("xyz")}
        # Written, as filters over it would otherwise repeat whatever its columns are made of.
        whole = cut(cut(moving.select("gid", "x", "y", "z")).select("gid", *[v.alias(c) for c, v in at.items()]))
        pairs, square = nearest_faced(whole, written, gate).agg(F.count("*"), F.avg(F.col("off") * F.col("off"))).first()
        sent = whole.where(" and ".join(f"abs({c}) < double('infinity')" for c in "xyz")).count()
        if pairs >= least:
            history.append(float(np.sqrt(square)))
    discard(written.dealt)
    return {"matrix": total.tolist(), "rms": history[-1] if history else None, "history": history, "iterations": tried, "pairs": pairs, "overlap": pairs / sent if sent else 0.0}
