"""Operators on the neighbour graph: greedy duplicates, connected components, orientation of normals.

Each settles first, in every tile, what the tile alone decides; Spark's rounds then run over what crosses from tile to
tile, which is little."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.neighbours import neighbourhoods
from pointloom.operators.tiles import Buckets, Carrying, Tiled, gathered
from pointloom.plans import stars
from pointloom.plans.lineage import cut, discard


def _by_tile(rows: DataFrame, tile: str, settle: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Runs ``settle`` over all rows of each tile, which a task holds at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            own = batch.column(tile).to_numpy()
            turns = np.flatnonzero(np.diff(own)) + 1
            for a, b in zip([0, *turns], [*turns, len(own)], strict=True):
                if a == b:
                    continue
                if own[a] != key:
                    if held:
                        yield from settle(pa.Table.from_batches(held))
                    key, held = own[a], []
                held.append(batch.slice(a, b - a))
        if held:
            yield from settle(pa.Table.from_batches(held))

    return rows.repartition(tile).sortWithinPartitions(tile).mapInArrow(run, schema)


def duplicates(cloud: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(gid, keep): in order of gid a point that stays removes later ones within ``tolerance``; removed ones remove nothing.

    That is the first independent set in gid order. Of points at the very same place only the first can stay, so one of
    each goes on. A tile walks its points in order and settles all that no open point of another tile can change; what is
    left waits for the next round, so rounds follow chains of tiles. Points without a place stay."""
    finite = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in "xyz")
    first = cut(cloud.where(finite).groupBy("x", "y", "z").agg(F.min("gid").alias("gid")).select("gid", "x", "y", "z"))
    tiled = Tiled(first)
    r2 = tolerance * tolerance

    def pairs(tile: int, tile_cloud: Buckets, gid: np.ndarray, at: np.ndarray, u2: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row, other, _ in gathered(tile_cloud.within(at, np.full(len(at), r2))):
            some = tile_cloud.gid[other] != gid[row]
            yield pa.RecordBatch.from_arrays([pa.array(gid[row[some]]), pa.array(tile_cloud.gid[other[some]]), pa.array(np.full(some.sum(), tile))], names=["gid", "nb", "there"])

    if tiled.plan.depth:
        homes = tiled.dealt.select("gid", F.col("tile").alias("home"))
        found = tiled.search(tiled.asked_within(first, tolerance), pairs, "gid long, nb long, there long").where("nb < gid")
        edges = found.join(homes, "gid")
    else:
        edges = tiled.search(None, pairs, "gid long, nb long, there long").where("nb < gid").withColumn("home", F.col("there"))
    # known: what is settled of a neighbour in another tile, null while it is open
    edges = cut(edges.select("gid", "nb", "home", (F.col("home") == F.col("there")).alias("inside"), F.lit(None).cast("boolean").alias("known")))
    gone, rounds = None, 0
    while True:
        rounds += 1
        result = cut(_by_tile(edges, "home", _settle, "gid long, nb long, home long, inside boolean, kept boolean"))
        settled = result.where("nb is null").select("gid", "kept")
        removed = settled.where("not kept").select("gid")
        gone = removed if gone is None else gone.unionAll(removed)
        left = result.where("nb is not null")
        if left.isEmpty():
            break
        told = settled.withColumnsRenamed({"gid": "nb", "kept": "told"})
        more = left.select("gid", "nb", "home", "inside").join(told, "nb", "left")
        if rounds == 1:  # a neighbour without a smaller one has no edge of its own, and stays
            more = more.join(result.select(F.col("gid").alias("nb"), F.lit(True).alias("has")).distinct(), "nb", "left").withColumn("told", F.coalesce("told", F.when(F.col("has").isNull(), True)))
        after = cut(more.select("gid", "nb", "home", "inside", F.col("told").alias("known")))
        discard(edges)
        edges = after
    rest = first.join(gone, "gid", "left_anti").select("gid")
    keep = rest.unionAll(cloud.where(f"not coalesce({finite}, false)").select("gid")).withColumn("_keep", F.lit(1))
    return cloud.select("gid").join(keep, "gid", "left").select("gid", F.coalesce("_keep", F.lit(0)).alias("keep"))


def _settle(edges: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows with nb null: points settled and whether they are kept. Other rows: edges of open points, without neighbours known to be gone."""
    gid, nb, home, inside = (edges.column(c).to_numpy() for c in ("gid", "nb", "home", "inside"))
    known = edges.column("known").to_pylist()
    order = np.lexsort((nb, gid))
    own = set(gid.tolist())
    state: dict[int, bool | None] = {}
    alive = np.ones(len(gid), bool)
    names, others, within = gid.tolist(), nb.tolist(), inside.tolist()
    at = 0
    order = order.tolist()
    while at < len(order):
        point, to, kept, open_ = names[order[at]], at, True, False
        while to < len(order) and names[order[to]] == point:
            k = order[to]
            to += 1
            # inside the tile a neighbour without edges of its own has no smaller neighbour and stays
            s = known[k] if not within[k] else (state[others[k]] if others[k] in own else (known[k] is not False))
            if s is True:
                kept = False
            elif s is None:
                open_ = True
            else:
                alive[k] = False
        state[point] = False if not kept else None if open_ else True
        at = to
    done = np.array([state[g] is not None for g in names], bool) if names else np.zeros(0, bool)
    settled = sorted(g for g, s in state.items() if s is not None)
    if settled:
        empty = pa.nulls(len(settled), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(settled, pa.int64()), empty, empty, pa.nulls(len(settled), pa.bool_()), pa.array([state[g] for g in settled])], names=["gid", "nb", "home", "inside", "kept"])
    left = ~done & alive
    if left.any():
        yield pa.RecordBatch.from_arrays([pa.array(gid[left]), pa.array(nb[left]), pa.array(home[left]), pa.array(inside[left]), pa.nulls(int(left.sum()), pa.bool_())], names=["gid", "nb", "home", "inside", "kept"])


def united(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least of 0 .. n - 1 that each is tied to by the pairs (i, j) and by ``root`` so far."""
    root = np.arange(n) if root is None else root
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def least_reachable(cloud: DataFrame, radius: float) -> DataFrame:
    """(gid, root): the least gid reachable by steps of at most ``radius``. Tiles unite their own points; only pairs across
    the edges of tiles, by the roots they have there, go on to Spark's rounds."""
    tiled = Tiled(cloud)
    r2 = radius * radius

    def unite(tile: int, points: Buckets, gid: np.ndarray, at: np.ndarray, u2: np.ndarray) -> Iterator[pa.RecordBatch]:
        by = np.argsort(points.gid, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        root = np.arange(len(by))
        for row, other, _ in gathered(points.within(points.at, np.full(len(by), r2)), 1 << 20):
            root = united(len(by), place[row], place[other], root)
        yield pa.RecordBatch.from_arrays([pa.array(points.gid[by]), pa.array(points.gid[by][root])], names=["gid", "root"])

    def across(tile: int, points: Buckets, gid: np.ndarray, at: np.ndarray, u2: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row, other, _ in gathered(points.within(at, np.full(len(at), r2))):
            some = gid[row] > points.gid[other]
            yield pa.RecordBatch.from_arrays([pa.array(gid[row[some]]), pa.array(points.gid[other[some]])], names=["a", "b"])

    local = tiled.search(None, unite, "gid long, root long")
    if tiled.plan.depth:
        local = cut(local)
        asked = tiled.asked_within(cloud, radius).join(tiled.dealt.select("gid", F.col("tile").alias("home")), "gid").where("tile <> home")
        met = tiled.search(asked.select("tile", "gid", "x", "y", "z"), across, "a long, b long")
        ends = met.join(local.withColumnsRenamed({"gid": "a", "root": "u"}), "a").join(local.withColumnsRenamed({"gid": "b", "root": "v"}), "b")
        named = cut(stars.components(ends.select(F.col("u").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()))
        local = local.join(named.withColumnRenamed("node", "root"), "root", "left").select("gid", F.coalesce("component", "root").alias("root"))
    return cloud.select("gid").join(local, "gid", "left").select("gid", F.coalesce("root", "gid").alias("root"))


def components(cloud: DataFrame, radius: float = 0.1, least: int = 16) -> DataFrame:
    """(gid, label): connected within ``radius``; labels by size, ties by least gid; null below ``least`` points."""
    roots = cut(least_reachable(cloud, radius))
    sizes = roots.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ranked = sizes.withColumn("label", F.row_number().over(Window.orderBy(F.desc("n"), "root")) - 1)  # a row for each component kept
    return roots.join(ranked.select("root", "label"), "root", "left").select("gid", "label")


def strongest(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, sign) of 0 .. n - 1: the least that each is tied to, and the product of signs on the way there over the spanning
    forest that grows by the strongest ``weight`` first, ties by ends.

    All trees grow at once by their strongest edge. Edges have an order without ties, so the forest is the one that a walk over
    them in that order would find."""
    order = np.lexsort((np.maximum(i, j), np.minimum(i, j), -np.abs(weight)))
    i, j, turn = i[order], j[order], np.where(weight[order] < 0, -1, 1)
    root, sign = np.arange(n), np.ones(n, np.int64)
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, turn, a, b = i[open_], j[open_], turn[open_], a[open_], b[open_]
        best = np.full(n, len(i))
        np.minimum.at(best, a, np.arange(len(i)))
        np.minimum.at(best, b, np.arange(len(i)))
        grows = np.flatnonzero(best < len(i))
        e = best[grows]
        up, way = np.arange(n), np.ones(n, np.int64)
        up[grows], way[grows] = a[e] + b[e] - grows, turn[e] * sign[i[e]] * sign[j[e]]
        both = np.flatnonzero((up[up] == np.arange(n)) & (up > np.arange(n)))  # two trees chose the same edge: the lesser is the root
        up[both], way[both] = both, 1
        while (up[up] != up).any():
            up, way = up[up], way * way[up]
        root, sign = up[root], sign * way[root]
    least = np.full(n, n)
    np.minimum.at(least, root, np.arange(n))
    return least[root], sign * sign[least[root]]


def _signs(points: pa.Table) -> Iterator[pa.RecordBatch]:
    """(gid, root, sign) of the points of one tile, by what they tell of neighbours in it."""
    gid, near = points.column("gid").to_numpy(), points.column("near").combine_chunks()
    each, own = near.flatten(), np.repeat(np.arange(len(gid)), near.value_lengths().to_numpy())
    nb, there, weight = (each.field(c).to_numpy() for c in ("nb", "there", "weight"))
    inside = (there == points.column("home")[0].as_py()) & (nb != gid[own])
    names, place = np.unique(gid, return_inverse=True)
    root, sign = strongest(len(names), place[own[inside]], np.searchsorted(names, nb[inside]), weight[inside])
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root]), pa.array(sign, pa.int32())], names=["gid", "root", "sign"])


def orient(cloud: DataFrame, k: int = 8, cell: float | None = None, viewpoint: tuple[float, float, float] | None = None) -> DataFrame:
    """The cloud with normals that agree along the graph of ``k`` neighbours: away from the cloud's middle, or toward ``viewpoint``.

    Within a tile signs spread along the strongest agreements. What stands between tiles is summed up for each pair of
    their parts, and a signed union of the parts gives every part its sign; its rounds grow with the logarithm of how many
    tiles lie in a row. Then each component as a whole turns by a vote of its points. ``cell`` changes nothing."""
    with_normal = cloud.where("nx is not null and ny is not null and nz is not null")
    tiled = Tiled(with_normal, carried=("nx", "ny", "nz"))
    plan = tiled.plan

    def agreement(cloud: Carrying, at: np.ndarray, row: np.ndarray, other: np.ndarray, d2: np.ndarray) -> list[pa.Array]:
        """How far normals agree is told where a neighbour is found, so no point is looked up by its id."""
        n, m = at[row, 3:], cloud.more[other]
        agree = n[:, 0] * m[:, 0] + n[:, 1] * m[:, 1] + n[:, 2] * m[:, 2]
        home, there = (plan.home(p) if len(p) else np.zeros(0, np.int64) for p in (at[:, :3], cloud.at[:1]))
        return [pa.array(v) for v in (d2, cloud.gid[other], home[row], np.full(len(row), there[0] if len(there) else 1), np.where(agree == 0, 1e-300, agree))]

    near = neighbourhoods(with_normal, k + 1, tiled=tiled, told=("d2 double, nb long, home long, there long, weight double", agreement))
    if plan.depth:
        near = cut(near)
    parts = cut(_by_tile(near.select("gid", F.col("near")[0]["home"].alias("home"), F.transform("near", lambda h: F.struct(h["nb"].alias("nb"), h["there"].alias("there"), h["weight"].alias("weight"))).alias("near")), "home", _signs, "gid long, root long, sign int"))
    across = near.select("gid", F.explode(F.filter("near", lambda h: h["home"] != h["there"])).alias("h")).select("gid", "h.nb", "h.weight")
    across = across.join(parts.withColumnsRenamed({"root": "a", "sign": "s"}), "gid")
    across = across.join(parts.select(F.col("gid").alias("nb"), F.col("root").alias("b"), F.col("sign").alias("t")), "nb")
    links = across.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.col("weight") * F.col("s") * F.col("t")).alias("weight"))
    named = cut(stars.signed_components(links.withColumn("weight", F.when(F.col("weight") == 0, F.lit(1e-300)).otherwise(F.col("weight")))))
    whole = with_normal.agg(*[F.avg(c).alias(f"_{c}") for c in "xyz"])  # one row
    turned = with_normal.join(parts, "gid").crossJoin(F.broadcast(whole))
    out = [(F.col(c) - F.col(f"_{c}")) if viewpoint is None else (F.lit(float(p)) - F.col(c)) for c, p in zip("xyz", viewpoint or (0, 0, 0), strict=True)]
    facing = F.col("sign") * (out[0] * F.col("nx") + out[1] * F.col("ny") + out[2] * F.col("nz"))
    # A part's points vote before parts meet: for, against, and neither, which counts against either way.
    count = lambda test: F.sum(test.cast("long"))
    votes = turned.groupBy("root").agg((count(facing > 0) - count(facing < 0)).alias("lean"), count(facing == 0).alias("flat"))
    joined = votes.join(named.withColumnRenamed("node", "root"), "root", "left").select("root", F.coalesce("component", "root").alias("component"), F.coalesce("sign", F.lit(1)).alias("turn"), "lean", "flat")
    verdict = joined.groupBy("component").agg((F.sum(F.col("lean") * F.col("turn")) - F.sum("flat")).alias("vote"))
    final = joined.join(verdict, "component").select("root", (F.col("turn") * F.when(F.col("vote") < 0, -1).otherwise(1)).alias("_turn"))
    signs = parts.join(final, "root").select("gid", (F.col("sign") * F.col("_turn")).alias("_sign"))
    result = cloud.join(signs, "gid", "left").withColumn("_sign", F.coalesce("_sign", F.lit(1)))
    return result.withColumns({f"n{c}": F.col(f"n{c}") * F.col("_sign") for c in "xyz"}).select(cloud.columns)
