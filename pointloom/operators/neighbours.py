"""Neighbour searches over balanced tiles (``tiles``): within a radius, the nearest, the nearest of another cloud, the
nearest triangle. Coordinates that are null or not finite are near nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.tiles import HIT, Buckets, Carrying, Tiled, Triangles, gathered, hits, places
from pointloom.plans.lineage import cut, discard


def radius_join(points: DataFrame, radius: float, reference: DataFrame | None = None) -> DataFrame:
    """(gid, nb, d2, dx, dy, dz) of all pairs within ``radius``, a point itself included; offsets are neighbour less point.

    A point asks every tile whose box stands within the radius, so what moves is the cloud once and points near the edges
    of tiles again."""
    tiled = Tiled(reference if reference is not None else points)
    r2 = radius * radius

    def answer(tile: int, cloud: Buckets, gid: np.ndarray, at: np.ndarray, u2: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row, other, d2 in gathered(cloud.within(at, np.full(len(at), r2))):
            yield pa.RecordBatch.from_arrays([pa.array(gid[row]), *hits(cloud, at, row, other, d2)], names=["gid", "d2", "nb", "dx", "dy", "dz"])

    alone = reference is None and not tiled.plan.depth
    found = tiled.search(None if alone else tiled.asked_within(points, radius), answer, f"gid long, {HIT}")
    return found.select("gid", "nb", "d2", "dx", "dy", "dz")


def radius_sums(points: DataFrame, radius: float) -> DataFrame:
    """(gid, found, m, far2, sx .. sz, sxx .. szz): of all points within ``radius`` their number, and of those with another id the number,
    the largest d2 and the sums of offsets and of their products. A tile adds up what it finds, so what moves on is a row for each
    point and tile, not for each pair."""
    tiled = Tiled(points)
    r2, sums = radius * radius, ["sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz"]

    def answer(tile: int, cloud: Buckets, gid: np.ndarray, at: np.ndarray, u2: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(gid)
        found, m, far, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros((9, n))
        for row, other, d2 in gathered(cloud.within(at, np.full(n, r2)), 1 << 20):
            found += np.bincount(row, minlength=n)
            some = cloud.gid[other] != gid[row]
            row, other, d2 = row[some], other[some], d2[some]
            m += np.bincount(row, minlength=n)
            np.maximum.at(far, row, d2)
            d = (cloud.at[other] - at[row]).T
            for k, v in enumerate((d[0], d[1], d[2], d[0] * d[0], d[0] * d[1], d[0] * d[2], d[1] * d[1], d[1] * d[2], d[2] * d[2])):
                total[k] += np.bincount(row, v, n)
        some = found > 0
        yield pa.RecordBatch.from_arrays([pa.array(v[some]) for v in (gid, found, m, far, *total)], names=["gid", "found", "m", "far2", *sums])

    alone = not tiled.plan.depth
    each = tiled.search(None if alone else tiled.asked_within(points, radius), answer, "gid long, found long, m long, far2 double, " + ", ".join(f"{c} double" for c in sums))
    return each.groupBy("gid").agg(F.sum("found").alias("found"), F.sum("m").alias("m"), F.max("far2").alias("far2"), *[F.sum(c).alias(c) for c in sums])


def neighbourhoods(points: DataFrame, m: int, reference: DataFrame | None = None, reach: float | None = None, tiled: Tiled | None = None, told: tuple[str, Callable] = (HIT, hits)) -> DataFrame:
    """(gid, near): the ``m`` nearest as an array of (d2, nb, dx, dy, dz), or of what else is ``told`` (d2 and nb first), from near to far, ties by id, a point itself
    included; empty where ``reach`` holds none. Exact for outliers and whatever the reach.

    The tile that a point falls into answers first. That bounds how far the point looks, and only tiles within the bound
    are asked as well: those beside it, for a point near its tile's edge. ``tiled``: the tiles, if they are there already."""
    tiled = tiled or Tiled(reference if reference is not None else points)
    most, plan, (fields, columns) = (np.inf if reach is None else reach * reach), tiled.plan, told
    names = [f.split()[0] for f in fields.split(", ")]

    def listed(cloud: Buckets, at: np.ndarray, u2: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The nearest of each place as lists, and the squared distance of the last where all ``m`` are there."""
        parts = list(gathered(cloud.nearest(at[:, :3], m, u2), 1 << 62)) or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        row, other, d2 = parts[0]
        by = np.argsort(row, kind="stable")
        row, other, d2 = row[by], other[by], d2[by]
        counts = np.bincount(row, minlength=len(at))
        last, full = np.full(len(at), np.inf), counts == m
        last[full] = d2[np.cumsum(counts)[full] - 1]
        each = pa.StructArray.from_arrays(columns(cloud, at, row, other, d2), names=names)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), each), last

    def first(cloud: Buckets, gid: np.ndarray, at: np.ndarray) -> tuple[list[pa.Array], np.ndarray]:
        lists, last = listed(cloud, at, np.full(len(at), most))
        bound = np.minimum(last, most)
        open_ = np.flatnonzero(np.isinf(bound))  # fewer than m at home: what boxes and their numbers say
        if plan.depth and len(open_):
            bound[open_] = plan.upper(at[open_, :3], m)
        return [lists], bound

    def second(cloud: Buckets, gid: np.ndarray, at: np.ndarray, u2: np.ndarray) -> list[pa.Array]:
        return [listed(cloud, at, u2)[0]]

    home, beyond = tiled.bounded(None if reference is None else points, first, second, f"near array<struct<{fields}>>")
    if beyond is None:
        return home.select("gid", "near")
    # As many lists as a point has asked tiles, each of at most m.
    edge = home.where("faces > 0").select("gid", "near").unionAll(beyond)
    merged = edge.groupBy("gid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, m).alias("near"))
    return home.where("faces = 0").select("gid", "near").unionAll(merged)


def nearest(points: DataFrame, m: int, radius: float | None = None, reference: DataFrame | None = None, reach: float | None = None) -> DataFrame:
    """(gid, nb, d2, dx, dy, dz, rank) of the ``m`` nearest, ties by id, a point itself included, within ``reach`` if given.

    ``radius``, a guess of how far neighbours are, may be given and changes nothing: tiles bound the search."""
    each = neighbourhoods(points, m, reference, reach).select("gid", F.posexplode("near").alias("rank", "h"))
    return each.select("gid", "h.nb", "h.d2", "h.dx", "h.dy", "h.dz", (F.col("rank") + 1).alias("rank"))


def nearest_one(points: DataFrame, reference: DataFrame, reach: float) -> DataFrame:
    """(gid, nb, d2, dx, dy, dz): the nearest within ``reach``, nulls where there is none; ties go to the least id."""
    return points.select("gid").join(nearest(points, 1, None, reference, reach).drop("rank"), "gid", "left")


class Written:
    """A cloud with normals that the same few places ask again and again: dealt to tiles and written once, tile by tile.

    A question of at most ``most`` places goes to the tasks by broadcast, so a round reads the cloud and moves only what it
    found. A tile that two tasks read answers twice; the nearer answer stays. Rows without coordinates or normals go."""

    NAMES = ("x", "y", "z", "nx", "ny", "nz")

    def __init__(self, cloud: DataFrame, most: int = 400_000) -> None:
        self.most, self.spark = most, cloud.sparkSession
        whole = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in self.NAMES)
        rows = cloud.select(F.col("gid").cast("long").alias("gid"), *[F.col(c).cast("double").alias(c) for c in self.NAMES]).where(whole)
        self.tiled = Tiled(rows, carried=self.NAMES[3:])
        plan, dealt = self.tiled.plan, self.tiled.dealt
        tasks = min(2**plan.depth, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 2**plan.depth // 8))
        self.plan, self.dealt = plan, cut(dealt.repartition(tasks, "tile").sortWithinPartitions("tile"))
        discard(dealt)
        self.tiled.dealt = self.dealt

    def nearest(self, gid: np.ndarray, at: np.ndarray, reach: float, known: np.ndarray | None = None) -> DataFrame:
        """(gid, d2, nb, x, y, z, dx, dy, dz, nx, ny, nz): the nearest within ``reach`` of each place that has one, ties to the least id,
        with the place that asked and the normal there.

        ``known``: for each place a distance within which it surely has a point, if any is known. A place asks the tiles within
        that, or within the farthest corner of the tile it falls into: a few, however many tiles the reach holds."""
        if len(gid) > self.most:
            raise ValueError(f"{len(gid)} places ask, at most {self.most} may")
        rows, tile, u2 = np.arange(len(gid)), np.ones(len(gid), np.int64), np.full(len(gid), reach * reach)
        if known is not None:
            u2 = np.fmin(u2, known * known)
        if self.plan.depth:
            u2 = np.minimum(u2, self.plan.around(at))
            rows, tile = self.plan.facing(at, u2)
        by = np.argsort(tile, kind="stable")
        rows, tile = rows[by], tile[by]
        asked = self.spark.sparkContext.broadcast((tile, gid[rows], at[rows], u2[rows]))  # at most ``most`` places, for each of the few tiles
        names = ["gid", "d2", "nb", "x", "y", "z", "dx", "dy", "dz", "nx", "ny", "nz"]

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tile, gid, at, u2 = asked.value
            for batch in batches:
                key = batch.column(0).to_numpy()
                turns = np.flatnonzero(np.diff(key)) + 1
                for a, b in zip([0, *turns], [*turns, len(key)], strict=True):
                    first, last = np.searchsorted(tile, key[a : a + 1], "left"), np.searchsorted(tile, key[a : a + 1], "right")
                    if a == b or first[0] == last[0]:
                        continue
                    g, p, most, own = gid[first[0] : last[0]], at[first[0] : last[0]], u2[first[0] : last[0]], batch.slice(a, b - a)
                    ids, normals = own.column(1).to_numpy(), places(own, 5)
                    by = np.argsort(ids, kind="stable")
                    cloud = Buckets(np.arange(len(ids)), places(own, 2)[by])
                    for row, other, d2 in gathered(cloud.nearest(p, 1, most)):
                        d2, at_, *away = hits(cloud, p, row, other, d2)
                        at_ = by[at_.to_numpy()]
                        from_, faced = ([pa.array(np.ascontiguousarray(v[:, k])) for k in range(3)] for v in (p[row], normals[at_]))
                        yield pa.RecordBatch.from_arrays([pa.array(g[row]), d2, pa.array(ids[at_]), *from_, *away, *faced], names=names)

        found = self.dealt.mapInArrow(answer, "gid long, d2 double, nb long, " + ", ".join(f"{c} double" for c in names[3:]))
        best = found.groupBy("gid").agg(F.min(F.struct(*names[1:])).alias("b"))
        return best.select("gid", "b.*")


def nearest_faced(points: DataFrame, fixed: Written, reach: float) -> DataFrame:
    """(gid, d2, nb, off): the nearest within ``reach`` of each of any number of points that has one, ties to the least id, with the
    offset to it along the normal there. Tiles hold the normals, so what is found needs no second look at ``fixed``."""
    r2 = reach * reach

    def found(cloud: Carrying, at: np.ndarray, u2: np.ndarray) -> list[np.ndarray]:
        d2, nb, off = np.full(len(at), np.inf), np.full(len(at), -1, np.int64), np.zeros(len(at))
        for row, other, each in gathered(cloud.nearest(at[:, :3], 1, u2)):
            d2[row], nb[row] = each, cloud.gid[other]
            off[row] = ((cloud.at[other] - at[row, :3]) * cloud.more[other]).sum(axis=1)
        return [d2, nb, off]

    def first(cloud: Carrying, gid: np.ndarray, at: np.ndarray) -> tuple[list[pa.Array], np.ndarray]:
        columns = found(cloud, at, np.full(len(at), r2))
        return [pa.array(c) for c in columns], np.minimum(columns[0], r2)

    def second(cloud: Carrying, gid: np.ndarray, at: np.ndarray, u2: np.ndarray) -> list[pa.Array]:
        return [pa.array(c) for c in found(cloud, at, u2)]

    home, beyond = fixed.tiled.bounded(points, first, second, "d2 double; nb long; off double")
    each = home.where("faces = 0").select("gid", "d2", "nb", "off")
    if beyond is not None:
        edge = home.where("faces > 0").select("gid", "d2", "nb", "off").unionAll(beyond)
        each = each.unionAll(edge.groupBy("gid").agg(F.min(F.struct("d2", "nb", "off")).alias("b")).select("gid", "b.*"))
    return each.where("d2 < double('infinity')")


def distance_to(points: DataFrame, reference: DataFrame, reach: float, signed: bool = False) -> DataFrame:
    """(gid, d): distance to the nearest reference point; with ``signed``, along its normal where it has one."""
    near = nearest_one(points, reference, reach)
    d = F.sqrt("d2")
    if signed:
        normals = reference.select(F.col("gid").alias("nb"), "nx", "ny", "nz")
        near = near.join(normals, "nb", "left")
        d = F.coalesce(-(F.col("dx") * F.col("nx") + F.col("dy") * F.col("ny") + F.col("dz") * F.col("nz")), d)
    return near.select("gid", d.alias("d"))


def mesh_distance(points: DataFrame, vertices: DataFrame, triangles: DataFrame, reach: float, signed: bool = False) -> DataFrame:
    """(gid, d): distance to the nearest triangle within ``reach``; null beyond, ties to the least tid. The nearest of the tile
    that a point falls into bounds how far it looks; ``signed`` takes the side of the triangle's plane."""
    corners = triangles.select(F.col("tid").alias("gid"), "a", "b", "c")
    for k in "abc":
        corners = corners.join(vertices.select(F.col("vid").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "xyz"]).hint("merge"), k)  # not by a guess of its size
    tiled = Tiled(corners, tuple(f"{k}{c}" for k in "abc" for c in "xyz"))
    r2 = reach * reach

    def first(mesh: Triangles, gid: np.ndarray, at: np.ndarray) -> tuple[list[pa.Array], np.ndarray]:
        found = mesh.nearest(at, np.full(len(at), r2))
        return [pa.array(x) for x in found], np.minimum(found[0], r2)

    def second(mesh: Triangles, gid: np.ndarray, at: np.ndarray, u2: np.ndarray) -> list[pa.Array]:
        return [pa.array(x) for x in mesh.nearest(at, u2)]

    home, beyond = tiled.bounded(points, first, second, "d2 double; tid long; side double")
    each = home.select("gid", "d2", "tid", "side")
    each = (each if beyond is None else each.unionAll(beyond)).where("d2 < double('infinity')")
    best = each.groupBy("gid").agg(F.min(F.struct("d2", "tid", "side")).alias("b"))
    d = F.sqrt("b.d2") * (F.when(F.col("b.side") < 0, -1.0).otherwise(1.0) if signed else F.lit(1.0))
    return points.select("gid").join(best.select("gid", d.alias("d")), "gid", "left")


def nearest_station(points: DataFrame, stations: DataFrame) -> DataFrame:
    """(gid, sid): the nearest station. Stations are few; they are broadcast after a check of their number."""
    n = stations.count()
    if n > 100_000:
        near = nearest(points, 1, None, stations.withColumnRenamed("sid", "gid"))
        return near.select("gid", F.col("nb").alias("sid"))
    s = stations.select("sid", *[F.col(c).alias(f"_{c}") for c in "xyz"])
    d = [F.col(f"_{c}") - F.col(c) for c in "xyz"]
    each = points.select("gid", "x", "y", "z").join(F.broadcast(s))
    return each.groupBy("gid").agg(F.min(F.struct((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d2"), "sid")).alias("b")).select("gid", "b.sid")
