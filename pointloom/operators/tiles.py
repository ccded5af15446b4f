"""Balanced tiles: where a search over a cloud takes place.

A cloud is halved along its longest side, again and again, where half of its points are, until a tile holds about
TILE_POINTS; cuts come from a bounded sample, so tiles hold alike many points wherever the cloud is dense. Points are
dealt to tiles once. A search then travels: an asking point starts in the tile it falls into, and what it finds there
bounds how far it still has to look; only tiles whose box stands within that bound are asked as well. Inside a tile,
points lie in small buckets with boxes of their own and whole buckets are compared at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.plans.lineage import cut

#: Points of a tile on average, halvings at most (a plan has at most 2^DEPTH boxes), sampled points for each tile, points of a bucket.
TILE_POINTS, DEPTH, SAMPLED, BUCKET = 16_384, 16, 64, 64
#: Rows that go out at once, distances that are held at once.
ROWS, DISTANCES = 100_000, 1 << 22
#: A little more than any rounding of a squared distance to a box.
SLACK = 1 - 1e-9

HIT = "d2 double, nb long, dx double, dy double, dz double"


def box_distance(lo: np.ndarray, hi: np.ndarray, at_lo: np.ndarray, at_hi: np.ndarray) -> np.ndarray:
    """The least squared distance between boxes (lo, hi) and (at_lo, at_hi), by broadcasting; empty boxes are infinitely far."""
    away = np.maximum(np.maximum(lo - at_hi, at_lo - hi), 0.0)
    return (away * away).sum(axis=-1)


class Plan:
    """Cuts in heap order, and the tight box and number of points of each node once they are known."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.axis, self.cut = np.zeros(2**depth, np.int64), np.zeros(2**depth)
        open_ = [(1, sample)]
        while open_:
            node, own = open_.pop()
            if node >= 2**depth:
                continue
            if len(own):
                side = own.max(axis=0) - own.min(axis=0)
                self.axis[node] = side.argmax()
                self.cut[node] = np.median(own[:, self.axis[node]])
            right = own[:, self.axis[node]] > self.cut[node]
            open_ += [(2 * node, own[~right]), (2 * node + 1, own[right])]
        self.lo, self.hi, self.n = np.full((2 ** (depth + 1), 3), np.inf), np.full((2 ** (depth + 1), 3), -np.inf), np.zeros(2 ** (depth + 1), np.int64)

    def home(self, at: np.ndarray) -> np.ndarray:
        """The tile that each place falls into."""
        node, rows = np.ones(len(at), np.int64), np.arange(len(at))
        for _ in range(self.depth):
            node = 2 * node + (at[rows, self.axis[node]] > self.cut[node])
        return node

    def bound(self, boxes: list[tuple]) -> None:
        """Takes the boxes (tile, n, lo, hi) of the tiles in and those of the nodes above from them."""
        for tile, n, *ends in boxes:
            self.n[tile], self.lo[tile], self.hi[tile] = n, ends[:3], ends[3:]
        for node in range(2**self.depth - 1, 0, -1):
            two = slice(2 * node, 2 * node + 2)
            self.n[node], self.lo[node], self.hi[node] = self.n[two].sum(), self.lo[two].min(axis=0), self.hi[two].max(axis=0)

    def facing(self, at: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, tile): the tiles whose box stands within squared distance ``d2`` of each place, by descent from the whole."""
        rows, node = np.arange(len(at)), np.ones(len(at), np.int64)
        for level in range(self.depth + 1):
            near = box_distance(self.lo[node], self.hi[node], at[rows], at[rows]) * SLACK <= d2[rows]
            rows, node = rows[near], node[near]
            if level < self.depth:
                rows, node = np.repeat(rows, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node))
        return rows, node

    def around(self, at: np.ndarray) -> np.ndarray:
        """A squared distance within which each place surely has a point: the farthest corner of its own tile's box."""
        node = self.home(at)
        far = np.maximum(np.abs(at - self.lo[node]), np.abs(at - self.hi[node]))
        return (far * far).sum(axis=1) / SLACK

    def upper(self, at: np.ndarray, k: int) -> np.ndarray:
        """A squared distance within which each place surely has ``k`` points: the farthest corners of boxes, nearest first."""
        tiles = np.flatnonzero(self.n[2**self.depth :]) + 2**self.depth
        out = np.full(len(at), np.inf)
        step = max(1, DISTANCES // max(1, 3 * len(tiles)))
        for a in range(0, len(at), step):
            p = at[a : a + step, None]
            far = np.maximum(np.abs(p - self.lo[tiles]), np.abs(p - self.hi[tiles]))
            far = (far * far).sum(axis=2)
            order = far.argsort(axis=1)
            enough = self.n[tiles][order].cumsum(axis=1) >= k
            first = enough.argmax(axis=1)
            row = np.arange(len(far))
            out[a : a + step] = np.where(enough.any(axis=1), far[row, order[row, first]] / SLACK, np.inf)
        return out


class Tiled:
    """Points, or triangles by their corners, dealt to tiles: ``plan``, and ``dealt`` (tile, gid, and the columns of
    ``names``), which is written once and read by every round. A triangle stands in the tile of its middle; boxes hold corners.

    Points may bring more numbers along, the columns ``carried``: then tiles are ``Carrying``, and places of the tile's own
    points have those numbers behind their coordinates wherever they ask."""

    def __init__(self, cloud: DataFrame, names: tuple[str, ...] = ("x", "y", "z"), points: int | None = None, carried: tuple[str, ...] = ()) -> None:
        self.spark, self.names, self.carried = cloud.sparkSession, names, carried
        source = _finite(cloud, names, carried)
        n = source.count()
        depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, n) / (points or TILE_POINTS)))))
        sample = np.zeros((0, 3))
        if depth:
            share = min(1.0, max(4096, SAMPLED * 2**depth) / n)
            chosen = source if share == 1.0 else source.where(F.pmod(F.xxhash64("gid", names[0], F.lit("tile")), F.lit(1 << 30)) < int(share * (1 << 30)))
            rows = chosen.select(*names).toArrow()  # about SAMPLED places for each of at most 2^DEPTH tiles
            sample = middles(np.stack([rows.column(k).to_numpy() for k in range(len(names))], axis=1))
            sample = sample[np.lexsort(sample.T)]
        self.plan = Plan(sample, depth)
        if not depth:
            self.dealt = source.select(F.lit(1).cast("long").alias("tile"), "gid", *names, *carried)
            return
        self.dealt = cut(self._at_home(source, names, carried))
        axis = lambda k: [F.col(c) for c in names[k::3]]
        least, most = (lambda c: F.least(*c) if len(c) > 1 else c[0]), (lambda c: F.greatest(*c) if len(c) > 1 else c[0])
        ends = [F.min(least(axis(k))) for k in range(3)] + [F.max(most(axis(k))) for k in range(3)]
        self.plan.bound([tuple(r) for r in self.dealt.groupBy("tile").agg(F.count("*"), *ends).collect()])  # a row for each tile

    def _at_home(self, rows: DataFrame, names: tuple[str, ...], carried: tuple[str, ...] = ()) -> DataFrame:
        plan = self.plan

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(plan.home(middles(places(batch, 1, len(names))))), *batch.columns], names=["tile", "gid", *names, *carried])

        return rows.mapInArrow(run, f"tile long, gid long, {', '.join(f'{c} double' for c in names + carried)}")

    def asked_at_home(self, points: DataFrame) -> DataFrame:
        """(tile, gid, x, y, z): where points of another cloud start."""
        return self._at_home(_finite(points), ("x", "y", "z"))

    def asked_within(self, points: DataFrame, radius: float) -> DataFrame:
        """(tile, gid, x, y, z): each point once for every tile within ``radius`` of it."""
        plan = self.plan

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = places(batch, 1)
                rows, tile = plan.facing(at, np.full(len(at), radius * radius)) if plan.depth else (np.arange(len(at)), np.ones(len(at), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(tile), *batch.take(pa.array(rows)).columns], names=["tile", "gid", "x", "y", "z"])

        return _finite(points).mapInArrow(run, "tile long, gid long, x double, y double, z double")

    def search(self, asked: DataFrame | None, answer: Callable, schema: str, build: Callable | None = None) -> DataFrame:
        """Runs ``answer(tile, cloud, gid, at, u2)`` in each tile over the points asked about: those of ``asked`` (tile, gid, x,
        y, z and, if any, u2), or the tile's own. A tile's points are held, those that ask stream by; a tile is one key of
        the shuffle, and there are many more tiles than tasks wherever there is much to do."""
        rows = self.dealt.select("tile", F.lit(2 if asked is None else 0).alias("side"), "gid", F.lit(float("inf")).alias("u2"), *self.names, *self.carried)
        if asked is not None:
            u2 = F.col("u2") if "u2" in asked.columns else F.lit(float("inf"))
            place = [F.col(c) for c in "xyz"] + [F.lit(None).cast("double")] * (len(self.names) - 3) + [F.col(c) if c in asked.columns else F.lit(None).cast("double") for c in self.carried]
            rows = rows.unionAll(asked.select("tile", F.lit(1).alias("side"), "gid", u2.alias("u2"), *place))
        tiles = 2**self.plan.depth
        tasks = min(tiles, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), tiles // 8))
        ordered = rows.repartition(tasks, "tile").sortWithinPartitions("tile", "side")
        return ordered.mapInArrow(_streamed(answer, build or self.build, len(self.names) + len(self.carried), 3 + len(self.carried)), schema)

    @property
    def build(self) -> Callable:
        return Triangles if len(self.names) > 3 else Carrying if self.carried else Buckets

    def bounded(self, points: DataFrame | None, first: Callable, second: Callable, schema: str) -> tuple[DataFrame, DataFrame | None]:
        """Answers (gid, and ``schema``) at home, and those of the tiles beyond that points still had to ask, None with one tile.

        ``first`` and ``second`` are answers as of ``search``; ``first`` gives with each row a bound u2 on how far to look, and the
        tiles that it reaches are asked. Of the first frame, ``faces`` says how many more answers a point gets."""
        plan, brought = self.plan, self.carried if points is None else ()

        def bound(tile: int, cloud: object, gid: np.ndarray, at: np.ndarray, u2: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(gid), 20_000):
                g, p = gid[a : a + 20_000], at[a : a + 20_000]
                columns, u2 = first(cloud, g, p)
                faces = pa.array([[]] * len(g), pa.list_(pa.int64()))
                if plan.depth:
                    rows, tiles = plan.facing(p[:, :3], u2)
                    rows, tiles = rows[tiles != tile], tiles[tiles != tile]
                    tiles = tiles[np.argsort(rows, kind="stable")]
                    faces = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=len(g)))), pa.int32()), pa.array(tiles))
                own = [pa.array(np.ascontiguousarray(p[:, k])) for k in range(3 + len(brought))]
                yield pa.RecordBatch.from_arrays([pa.array(g), *own, pa.array(u2), faces, *columns], names=["gid", "x", "y", "z", *brought, "u2", "faces", *names])

        def more(tile: int, cloud: object, gid: np.ndarray, at: np.ndarray, u2: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(gid), *second(cloud, gid, at, u2)], names=["gid", *names])

        names = [part.strip().split(" ")[0].split(":")[0] for part in schema.split(";")]
        schema = schema.replace(";", ",")
        own = ", ".join(f"{c} double" for c in ("x", "y", "z", *brought, "u2"))
        home = self.search(None if points is None else self.asked_at_home(points), bound, f"gid long, {own}, faces array<long>, {schema}")
        if not plan.depth:
            return home.select("gid", F.lit(0).alias("faces"), *names), None
        home = cut(home)
        asked = home.select(F.explode("faces").alias("tile"), "gid", "x", "y", "z", *brought, "u2")
        return home.select("gid", F.size("faces").alias("faces"), *names), self.search(asked, more, f"gid long, {schema}")


def _finite(cloud: DataFrame, names: tuple[str, ...] = ("x", "y", "z"), carried: tuple[str, ...] = ()) -> DataFrame:
    """(gid, coordinates, and what is carried) of the rows that have all coordinates."""
    rows = cloud.select(F.col("gid").cast("long").alias("gid"), *[F.col(c).cast("double").alias(c) for c in names + carried])
    return rows.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in names))


def places(batch: pa.RecordBatch, first: int, width: int = 3) -> np.ndarray:
    return np.stack([batch.column(first + k).to_numpy(zero_copy_only=False) for k in range(width)], axis=1).astype(np.float64)


def middles(at: np.ndarray) -> np.ndarray:
    """The mean of each row's places: one for a point, three for a triangle."""
    return at if at.shape[1] == 3 else at.reshape(len(at), -1, 3).mean(axis=1)


def _streamed(answer: Callable, build: Callable, width: int, asking: int = 3) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, cloud, own = None, [], None, False

        def built() -> object:
            return build(np.concatenate([np.zeros(0, np.int64), *[g for g, _ in held]]), np.concatenate([np.zeros((0, width)), *[p for _, p in held]]))

        def close() -> Iterator[pa.RecordBatch]:
            if own and held:
                c = built()
                yield from answer(tile, c, c.gid, c.all if asking > 3 else c.at, np.full(len(c.gid), np.inf))

        for batch in batches:
            key, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            gid, u2, at = batch.column(2).to_numpy(), batch.column(3).to_numpy(), places(batch, 4, width)
            turns = np.flatnonzero((np.diff(key) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *turns], [*turns, len(key)], strict=True):
                if a == b:
                    continue
                if key[a] != tile:
                    yield from close()
                    tile, held, cloud, own = int(key[a]), [], None, side[a] == 2
                if side[a] != 1:
                    held.append((gid[a:b], at[a:b]))
                    continue
                cloud = built() if cloud is None else cloud
                yield from answer(tile, cloud, gid[a:b], at[a:b, :asking], u2[a:b])
        yield from close()

    return run


def bucketed(at: np.ndarray, most: int = BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows so ordered that each bucket is a run of at most ``most``, halved along the longest side."""
    out, starts, open_, done = [], [], [np.arange(len(at))] if len(at) else [], 0
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            out.append(np.sort(rows))
            starts.append(done)
            done += len(rows)
            continue
        own = at[rows]
        axis = (own.max(axis=0) - own.min(axis=0)).argmax()
        half = len(rows) // 2
        order = rows[np.argpartition(own[:, axis], half)]
        open_ += [order[half:], order[:half]]
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.array(starts, np.int64)


class Buckets:
    """A tile's points in buckets: gid, at, and each bucket's box."""

    def __init__(self, gid: np.ndarray, at: np.ndarray) -> None:
        by = np.argsort(gid, kind="stable")
        gid, at = gid[by], at[by]
        order, self.starts = bucketed(at)
        self.gid, self.at = gid[order], at[order]
        self.ends = np.append(self.starts[1:], len(order))
        if len(order):
            self.lo, self.hi = np.minimum.reduceat(self.at, self.starts), np.maximum.reduceat(self.at, self.starts)
        self.size = self.ends - self.starts
        self.order = by[order]

    def _rows(self, buckets: np.ndarray) -> np.ndarray:
        size = self.size[buckets]
        return np.repeat(self.starts[buckets] - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def _distances(self, p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        q = self.at[rows]
        d = [q[None, :, k] - p[:, None, k] for k in range(3)]
        return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]

    def within(self, at: np.ndarray, d2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, other, d2) of all pairs within ``d2``, some places at a time; ``other`` indexes this tile's points."""
        if not len(self.gid):
            return
        order, starts = bucketed(at)
        for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
            rows = order[a:b]
            p = at[rows]
            near = np.flatnonzero(box_distance(self.lo, self.hi, p.min(axis=0), p.max(axis=0)) * SLACK <= d2[rows].max())
            others = self._rows(near)
            step = max(1, DISTANCES // max(1, len(p)))
            for s in range(0, len(others), step):
                some = others[s : s + step]
                each = self._distances(p, some)
                i, j = np.nonzero(each <= d2[rows][:, None])
                if len(i):
                    yield rows[i], some[j], each[i, j]

    def nearest(self, at: np.ndarray, k: int, u2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, other, d2) of the ``k`` nearest within ``u2`` of each place, rows together and each from near to far, ties by gid."""
        if not len(self.gid):
            return
        order, starts = bucketed(at)
        for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
            rows = order[a:b]
            p, most = at[rows], u2[rows]
            far = box_distance(self.lo, self.hi, p.min(axis=0), p.max(axis=0)) * SLACK
            by = far.argsort(kind="stable")
            # The buckets nearest by their boxes give a first bound; the buckets within it are all that can hold more.
            first = by[: np.searchsorted(self.size[by].cumsum(), k) + 1]
            if len(first) < len(by):
                each = self._distances(p, self._rows(first))
                if each.shape[1] >= k:
                    most = np.minimum(most, np.partition(each, k - 1, axis=1)[:, k - 1])
            yield from self._best(rows, p, most, by[far[by] <= most.max()], k)

    def _best(self, rows: np.ndarray, p: np.ndarray, most: np.ndarray, buckets: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        others = self._rows(buckets)
        kept: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        step = max(k, DISTANCES // max(1, len(p)))
        for s in range(0, len(others), step):
            some = others[s : s + step]
            each = self._distances(p, some)
            if each.shape[1] > k:
                most = np.minimum(most, np.partition(each, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero(each <= most[:, None])
            found = [np.concatenate(x) for x in zip(kept, (i, some[j], each[i, j]), strict=True)]
            by = np.lexsort((self.gid[found[1]], found[2], found[0]))
            i, j, d = (f[by] for f in found)
            place = np.arange(len(i)) - np.searchsorted(i, i)
            kept = (i[place < k], j[place < k], d[place < k])
        if len(kept[0]):
            yield rows[kept[0]], kept[1], kept[2]


class Carrying(Buckets):
    """A tile's points in buckets with what they carry: ``more`` beside ``at``, ``all`` both."""

    def __init__(self, gid: np.ndarray, at: np.ndarray) -> None:
        super().__init__(gid, at[:, :3])
        self.all = at[self.order]
        self.more = self.all[:, 3:]


def hits(cloud: Buckets, at: np.ndarray, row: np.ndarray, other: np.ndarray, d2: np.ndarray) -> list[pa.Array]:
    """The columns of HIT."""
    away = cloud.at[other] - at[row, :3]
    return [pa.array(d2), pa.array(cloud.gid[other]), *[pa.array(np.ascontiguousarray(away[:, k])) for k in range(3)]]


def gathered(parts: Iterator[tuple], most: int = ROWS) -> Iterator[tuple]:
    """Tuples of arrays, put together until they hold about ``most`` rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= most:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


class Triangles:
    """A tile's triangles (nine numbers each) in buckets by their middles: gid, and each bucket's box."""

    def __init__(self, gid: np.ndarray, at: np.ndarray) -> None:
        by = np.argsort(gid, kind="stable")
        order, self.starts = bucketed(middles(at[by]), BUCKET // 2)
        self.gid, corners = gid[by][order], at[by][order].reshape(-1, 3, 3)
        self.ends = np.append(self.starts[1:], len(order))
        if len(order):
            self.lo, self.hi = np.minimum.reduceat(corners.min(axis=1), self.starts), np.maximum.reduceat(corners.max(axis=1), self.starts)
        a, b, c = corners[:, 0], corners[:, 1], corners[:, 2]
        self.a, self.b, self.u, self.v, self.w = a, b, b - a, c - a, c - b
        self.n = np.cross(self.u, self.v)
        dot = lambda p, q: (p * q).sum(axis=1)
        self.uu, self.vv, self.uv, self.ww, self.nn = dot(self.u, self.u), dot(self.v, self.v), dot(self.u, self.v), dot(self.w, self.w), dot(self.n, self.n)

    def distances(self, p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(squared distance, which side) of each place to each triangle: of the foot on the plane if inside, else of the edges."""
        dot = lambda d, e: d[..., 0] * e[..., 0] + d[..., 1] * e[..., 1] + d[..., 2] * e[..., 2]
        to_a, to_b = p[:, None] - self.a[t], p[:, None] - self.b[t]
        u, v, w, n = self.u[t][None], self.v[t][None], self.w[t][None], self.n[t][None]
        pu, pv, qw, pn = dot(to_a, u), dot(to_a, v), dot(to_b, w), dot(to_a, n)

        def along(d: np.ndarray, e: np.ndarray, share: np.ndarray, whole: np.ndarray) -> np.ndarray:
            f = np.clip(np.divide(share, whole, out=np.zeros_like(share), where=whole > 0), 0.0, 1.0)[..., None]
            r = d - e * f
            return dot(r, r)

        uu, vv, uv, ww, nn = (x[t][None] for x in (self.uu, self.vv, self.uv, self.ww, self.nn))
        edges = np.minimum(np.minimum(along(to_a, u, pu, uu), along(to_a, v, pv, vv)), along(to_b, w, qw, ww))
        flat = np.broadcast_to(nn > 0, pn.shape)
        s = np.divide(vv * pu - uv * pv, nn, out=np.full_like(pn, -1.0), where=flat)
        r = np.divide(uu * pv - uv * pu, nn, out=np.full_like(pn, -1.0), where=flat)
        plane = np.divide(pn * pn, nn, out=np.zeros_like(pn), where=flat)
        return np.where((s >= 0) & (r >= 0) & (s + r <= 1), plane, edges), np.sign(pn)

    def nearest(self, at: np.ndarray, u2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(d2, gid, side) of each place's nearest triangle within ``u2``, ties by gid; infinite and -1 where there is none."""
        best, who, side = np.full(len(at), np.inf), np.full(len(at), -1, np.int64), np.zeros(len(at))
        if not len(self.gid):
            return best, who, side
        order, starts = bucketed(at, BUCKET // 2)
        for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
            rows = order[a:b]
            p = at[rows]
            far = box_distance(self.lo, self.hi, p.min(axis=0), p.max(axis=0)) * SLACK
            bound = u2[rows].max()
            for bucket in far.argsort(kind="stable"):
                if far[bucket] > min(bound, best[rows].max()):
                    break
                t = np.arange(self.starts[bucket], self.ends[bucket])
                d2, on = self.distances(p, t)
                low = d2.min(axis=1)
                first = np.where(d2 == low[:, None], self.gid[t][None], np.iinfo(np.int64).max).argmin(axis=1)
                g, k = self.gid[t][first], np.arange(len(rows))
                better = (low <= u2[rows]) & ((low < best[rows]) | ((low == best[rows]) & (g < who[rows])))
                chosen = rows[better]
                best[chosen], who[chosen], side[chosen] = low[better], g[better], on[k, first][better]
        return best, who, side
