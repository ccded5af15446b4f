"""Hard-negative mining by dual-tree search.

Vectors, as whole numbers, are sent down a tree of balls whose upper splits are fitted on a bounded sample; within each
leaf, tasks build the lower splits over chunks of bounded size, down to blocks. Anchors get a tree of their own over
the same splits. For a pair of nodes the inner products of all their rows lie within an interval about that of the two
centres; a pair whose interval holds nothing that any anchor below still looks for is pruned, with the whole group of
anchors at once. Pairs of blocks that are left are scored exactly.

Positives are found first: what an anchor has in its own neighbourhood gives the score that other nodes must reach.
They set each anchor's windows, and negatives are found alike. The search is exact: pruning only saves work, and how
much it saves depends on how well the vectors cluster."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import arrow_rows, drawn, saved

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Vectors that fit the upper splits, their levels at most, rows of a chunk, numbers of a chunk, rows of a block, of anchors.
SAMPLE, DEPTH, CHUNK, NUMBERS, BLOCK, ANCHORS = 20_000, 10, 4096, 1 << 20, 512, 256
#: Components that a ball's centre has; what lies beyond widens the ball. Parts that the blocks facing an anchor block are dealt to.
CENTRE, PARTS = 1024, 8
#: Pairs of blocks that a Python worker holds at once.
TOGETHER = 8
#: The largest whole number up to which all are doubles.
EXACT = 1 << 53

BALL = "centre array<double>, radius double, norm double, low long, high long"
PACKED = f"names array<long>, ids binary, rows binary, labels binary, size int, dim int, kind string, matrix binary, {BALL}"


def _whole(vectors: pa.Array) -> np.ndarray:
    """Rows of whole numbers, as doubles; shorter vectors are filled up with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = np.clip(np.floor(flat * SCALE), -np.finfo(np.float64).max, np.finfo(np.float64).max)
    dim = int(sizes.max(initial=0))
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _direction(x: np.ndarray) -> np.ndarray:
    """From one far row to another: across the longest way, nearly."""
    a = x[np.abs(x - x.mean(axis=0)).sum(axis=1).argmax()]
    return x[np.abs(x - a).sum(axis=1).argmax()] - a


class Splits:
    """The upper splits: a direction and a cut, the median of the sample's projections, for each node of each level."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.dim, self.levels = sample.shape[1], []
        nodes = np.zeros(len(sample), np.int64)
        for level in range(depth):
            directions, cuts = np.zeros((2**level, self.dim)), np.zeros(2**level)
            for node in np.unique(nodes):
                own = sample[nodes == node]
                directions[node] = _direction(own)
                cuts[node] = np.median(own @ directions[node])
            self.levels.append((directions, cuts))
            nodes = self._step(sample, nodes, level)

    def _step(self, x: np.ndarray, nodes: np.ndarray, level: int) -> np.ndarray:
        directions, cuts = self.levels[level]
        return 2 * nodes + (np.einsum("ij,ij->i", x, directions[nodes]) > cuts[nodes])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        width = min(self.dim, x.shape[1])
        own = np.zeros((len(x), self.dim))
        own[:, :width] = x[:, :width]
        nodes = np.zeros(len(x), np.int64)
        for level in range(len(self.levels)):
            nodes = self._step(own, nodes, level)
        return nodes


def _ball(x: np.ndarray, labels: np.ndarray) -> dict:
    centre = x[:, :CENTRE].mean(axis=0)
    away = x.copy()
    away[:, :CENTRE] -= centre
    return {
        "centre": centre.tolist(), "radius": float(np.linalg.norm(away, axis=1).max()), "norm": float(np.linalg.norm(x, axis=1).max()),
        "low": int(labels.min()), "high": int(labels.max()),
    }


def _split(x: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows in blocks of at most ``most``: halves along a far direction, again and again."""
    open_ = [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            yield rows
            continue
        order = rows[np.argsort(x[rows] @ _direction(x[rows]), kind="stable")]
        open_ += [order[: len(order) // 2], order[len(order) // 2 :]]


def _packer(most: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """A chunk's rows as blocks, each one row: ids ascending, the matrix in the narrowest kind that holds it."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        ids, row, labels = (rows.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "row", "label"))
        x, out = _whole(rows.column("embedding")), []
        for part in _split(x, most):
            part = np.sort(part)
            own, top = x[part], np.abs(x[part]).max(initial=0)
            kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
            out.append({
                "node": key[0].as_py(), "chunk": key[1].as_py(), "names": ids[part].tolist(), "ids": ids[part].tobytes(), "rows": row[part].tobytes(), "labels": labels[part].tobytes(),
                "size": len(part), "dim": own.shape[1], "kind": kind, "matrix": own.astype(kind).tobytes(), **_ball(own, labels[part]),
            })
        return pa.Table.from_pylist(out, BLOCKS)

    return run


BLOCKS = pa.schema([
    ("node", pa.int64()), ("chunk", pa.int64()), ("names", pa.list_(pa.int64())), ("ids", pa.binary()), ("rows", pa.binary()), ("labels", pa.binary()), ("size", pa.int32()), ("dim", pa.int32()),
    ("kind", pa.string()), ("matrix", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("norm", pa.float64()), ("low", pa.int64()), ("high", pa.int64()),
])

NODES = pa.schema([("node", pa.int64()), ("chunks", pa.int64()), *[BLOCKS.field(c) for c in ("centre", "radius", "norm", "low", "high")]])


def inner(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products of rows of whole numbers, exactly, as int64; beyond the range of int64 they are its ends.

    Doubles hold every partial sum while none can pass EXACT; else the sums are Python's whole numbers."""
    width = min(a.shape[1], c.shape[1])
    a, c = a[:, :width], c[:, :width]
    if float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, width) < EXACT:
        return (a @ c.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)
    ends = np.iinfo(np.int64)
    return np.array([[min(max(int(v), ends.min), ends.max) for v in r] for r in (whole(a) @ whole(c).T).tolist()], np.int64).reshape(len(a), len(c))


def interval(a: dict, c: dict) -> tuple[float, float]:
    """What inner products of a row of ball ``a`` and one of ball ``c`` can be."""
    x, y = np.asarray(a["centre"]), np.asarray(c["centre"])
    width = min(len(x), len(y))
    middle = float(x[:width] @ y[:width])
    reach = a["radius"] * float(np.linalg.norm(y)) + c["radius"] * float(np.linalg.norm(x)) + a["radius"] * c["radius"]
    most = a["norm"] * c["norm"]
    slack = 1e-6 + 1e-9 * (abs(middle) + reach)
    return max(middle - reach, -most) - slack, min(middle + reach, most) + slack


def needed(a: dict, c: dict, same: bool) -> bool:
    """Whether a pair of nodes may hold what anchors of ``a`` look for: scores from ``least`` to ``most``, and of the same
    label, or of others."""
    if (a["high"] < c["low"] or c["high"] < a["low"]) if same else a["low"] == a["high"] == c["low"] == c["high"]:
        return False
    low, high = interval(a, c)
    return high >= a["least"] and low <= a["most"]


def _merged(balls: list[dict]) -> dict:
    """The ball, and what is looked for, of several balls together."""
    width = max(len(b["centre"]) for b in balls)
    centres = np.array([[*b["centre"], *[0.0] * (width - len(b["centre"]))] for b in balls])
    centre = centres.mean(axis=0)
    out = {"centre": centre, "radius": float((np.linalg.norm(centres - centre, axis=1) + [b["radius"] for b in balls]).max())}
    ends = {"norm": max, "low": min, "high": max, "least": min, "most": max}
    return out | {k: f(b[k] for b in balls) for k, f in ends.items() if k in balls[0]}


class Tree:
    """A binary tree over balls that stand in the order of their splits."""

    def __init__(self, balls: list[dict]) -> None:
        self.children: list[Tree] = []
        if len(balls) > 1:
            self.children = [Tree(balls[: len(balls) // 2]), Tree(balls[len(balls) // 2 :])]
        self.ball = _merged([t.ball for t in self.children]) if self.children else balls[0]

    def meet(self, other: Tree, same: bool) -> Iterator[tuple[dict, dict]]:
        """Pairs of balls, of anchors here and of candidates there, that are needed; the wider node of a pair opens first."""
        open_ = [(self, other)]
        while open_:
            a, c = open_.pop()
            if not needed(a.ball, c.ball, same):
                continue
            if a.children and (not c.children or a.ball["radius"] >= c.ball["radius"]):
                open_ += [(t, c) for t in a.children]
            elif c.children:
                open_ += [(a, t) for t in c.children]
            else:
                yield a.ball, c.ball


def _facing(leaves: list[dict], same: bool):
    """Batches of anchor blocks, in the order of their tree, to (block, node, chunk) of the leaves' chunks they must meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(leaves) if leaves else None
        for batch in batches:
            anchors = batch.to_pylist()
            if not anchors or tree is None:
                continue
            met = [(a["block"], c["node"], c["chunks"]) for a, c in Tree(anchors).meet(tree, same)]
            for at in range(0, len(met), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in met[at : at + 10_000]], pa.int64()) for k in range(3)], names=["block", "node", "chunks"])

    return run


def _narrow(same: bool):
    """Keeps pairs of an anchor block (names begin with a_) and a candidate block that are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            kept = [r for r in rows if needed({k[2:]: v for k, v in r.items() if k.startswith("a_")}, r, same)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in kept], pa.int64()) for c in ("block", "facing")], names=["block", "facing"])

    return run


FOUND = "block long, slot int, part int, score long, id long, row long"


def _unpacked(r: dict, tag: str = "") -> tuple[np.ndarray, ...]:
    ids, rows, labels = (np.frombuffer(r[tag + c], np.int64) for c in ("ids", "rows", "labels"))
    return ids, rows, labels, np.frombuffer(r[tag + "matrix"], r[tag + "kind"]).reshape(r[tag + "size"], r[tag + "dim"]).astype(np.float64)


def _best(k: int, low: int | None, high: int | None):
    """Rows of an anchor block (a_) and a candidate block, to the best ``k`` found for each anchor (and each of its windows,
    as percent of its positives, if ``low`` and ``high`` are given). A task sends on only its best."""

    def top(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, kept: dict, slot: tuple) -> None:
        own = kept.get(slot, [])
        kept[slot] = sorted([*own, *zip((-scores).tolist(), ids.tolist(), rows.tolist(), strict=True)])[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                (_, own, label, a), (ids, rows, labels, c) = _unpacked(r, "a_"), _unpacked(r)
                scores = inner(a, c)
                alike = labels == label[:, None]
                fit = alike & (rows != own[:, None]) if low is None else ~alike
                ends = np.iinfo(np.int64).min
                scores = np.where(fit, scores, ends)
                order = np.argsort(~scores, axis=1, kind="stable")  # falling; ids ascend, so ties are right
                ranked = np.take_along_axis(scores, order, axis=1)
                sizes = fit.sum(axis=1)
                for slot in range(len(a)):
                    n = sizes[slot]
                    if not n:
                        continue
                    if low is None:
                        at = order[slot, : min(k, n)]
                        top(scores[slot, at], ids[at], rows[at], kept, (r["block"], slot, 0))
                        continue
                    falling = ~ranked[slot, :n]
                    for part, positive in enumerate(r["a_wanted"][slot] or []):
                        most = high * (positive // 100) + high * (positive % 100) // 100
                        least = -(low * (-positive // 100) + low * (-positive % 100) // 100)
                        first, last = np.searchsorted(falling, ~most, side="left"), np.searchsorted(falling, ~least, side="right")
                        if first < last:
                            at = order[slot, first : min(first + k, last)]
                            top(scores[slot, at], ids[at], rows[at], kept, (r["block"], slot, part))
        flat = [(b, s, p, -score, i, row) for (b, s, p), best in kept.items() for score, i, row in best]
        for at in range(0, len(flat), 50_000):
            some = list(zip(*flat[at : at + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(some, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["block", "slot", "part", "score", "id", "row"])

    return run


class Search:
    """Candidate and anchor blocks of one table, and searches over them."""

    def __init__(self, rows: DataFrame) -> None:
        """``rows``: (vec_id, row, label, embedding, anchor), saved."""
        n, anchors = rows.agg(F.count("*"), F.sum(F.col("anchor").cast("long"))).first()
        sample = drawn(rows.select("embedding", "row"), SAMPLE, "row").orderBy("row").select(F.slice("embedding", 1, CENTRE).alias("embedding")).toArrow()
        points = _whole(sample.column(0)) if sample.num_rows else np.zeros((0, 1))
        depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, n) / CHUNK))), max(0, int(math.log2(max(1, len(points)) / 16))))
        splits = Splits(points, depth)
        self.up = depth - min(depth, max(0, math.ceil(math.log2(max(1, anchors or 0) / ANCHORS))))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = splits.leaves(_whole(batch.column(3)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

        placed = rows.mapInArrow(place, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, leaf long")
        # Rows of like length stand together, so filling up at most doubles them: 32 classes of length a leaf.
        wide = F.least(F.ceil(F.log2(F.greatest(F.size("embedding"), F.lit(1)))), F.lit(31)).cast("long")
        self.placed = saved(placed.withColumn("wide", wide).withColumn("node", F.col("leaf") * 32 + F.col("wide")), "placed")
        self.blocks = self._blocks(self.placed, BLOCK)
        above = F.shiftright("leaf", self.up) * 32 + F.col("wide")
        self.anchors = self._blocks(self.placed.where("anchor").withColumn("node", above), ANCHORS)
        self.leaves = self._leaves()

    def _blocks(self, rows: DataFrame, most: int) -> DataFrame:
        """(block, node, chunk, chunks, packed rows, ball): chunks of bounded size by a hash of the row, split into blocks in their task."""
        room = F.greatest(F.least(F.lit(CHUNK * most // BLOCK), F.lit(NUMBERS) / F.pow(F.lit(2), F.col("wide"))), F.lit(1))
        sizes = rows.groupBy("node", "wide").agg(F.count("*").alias("n")).select(F.col("node").alias("_node"), F.ceil(F.col("n") / room).alias("chunks"))
        # A row for each node: at most 32 classes of 2^DEPTH leaves.
        dealt = rows.join(F.broadcast(sizes), F.col("node") == F.col("_node")).withColumn("chunk", F.pmod(F.xxhash64("row", F.lit("chunk")), F.col("chunks")))
        packed = dealt.select("node", "chunk", "vec_id", "row", "label", "embedding").groupBy("node", "chunk").applyInArrow(_packer(most), f"node long, chunk long, {PACKED}")
        return saved(packed.withColumn("block", F.monotonically_increasing_id()).join(F.broadcast(sizes), F.col("node") == F.col("_node")).drop("_node"), "blocks")

    def _leaves(self) -> list[dict]:
        """The ball of each node of candidates, in the order of the splits: at most 32 classes of 2^DEPTH leaves."""

        def merge(key: tuple, rows: pa.Table) -> pa.Table:
            ball = _merged(rows.select(["centre", "radius", "norm", "low", "high"]).to_pylist())
            return pa.Table.from_pylist([{"node": key[0].as_py(), "chunks": rows.column("chunks")[0].as_py(), **ball, "centre": ball["centre"].tolist()}], NODES)

        # A chunk's balls are merged first, so a leaf of very many blocks does not meet whole in one task but as chunks.
        part = F.pmod(F.col("chunk"), F.lit(256))
        first = self.blocks.select("node", part.alias("part"), "chunks", "centre", "radius", "norm", "low", "high")
        merged = first.groupBy("node", "part").applyInArrow(merge, f"node long, chunks long, {BALL}")
        return merged.groupBy("node").applyInArrow(merge, f"node long, chunks long, {BALL}").orderBy("node").toArrow().to_pylist()

    def find(self, wanted: DataFrame, k: int, same: bool, low: int | None = None, high: int | None = None, near: bool = False) -> DataFrame:
        """(block, slot, part, score, id, row): the best in the anchors' own neighbourhood (``near``: the first chunk of each
        leaf below their node), or in all else that ``wanted`` (block, least, most, wanted) needs."""
        ball = ["centre", "radius", "norm", "low", "high"]
        anchors = self.anchors.join(wanted, "block")
        above = F.shiftright(F.shiftright("node", 5), self.up)
        here = self.blocks.select(F.col("block").alias("facing"), "node", "chunk", *ball, above.alias("above"))
        sides = anchors.select("block", F.col("node").alias("_own"), *[F.col(c).alias(f"a_{c}") for c in (*ball, "least", "most")])
        if near:
            pairs = sides.join(here.where("chunk = 0"), F.shiftright("_own", 5) == F.col("above"))
        else:
            ordered = anchors.select("block", "node", *ball, "least", "most").repartitionByRange("node", "block").sortWithinPartitions("node", "block")
            met = ordered.drop("node").mapInArrow(_facing(self.leaves, same), "block long, node long, chunks long")
            met = met.select("block", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
            pairs = met.join(here, ["node", "chunk"]).join(sides, "block").where("chunk > 0 or above <> shiftright(_own, 5)")
        pairs = saved(pairs.select("block", "facing", *ball, *[f"a_{c}" for c in (*ball, "least", "most")]).mapInArrow(_narrow(same), "block long, facing long"), "pairs")
        full = ["ids", "rows", "labels", "size", "dim", "kind", "matrix"]
        there = self.blocks.select(F.col("block").alias("facing"), *full)
        dealt = pairs.join(there, "facing").withColumn("part", F.pmod("facing", F.lit(PARTS)))
        asking = anchors.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"), *[F.col(c).alias(f"a_{c}") for c in full], F.col("wanted").alias("a_wanted"))
        with arrow_rows(pairs.sparkSession, TOGETHER):
            return saved(dealt.join(asking, ["block", "part"]).drop("part", "facing").mapInArrow(_best(k, low, high), FOUND), "found")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor and window, ranked from 1; each task has sent at most k of them."""
    order = Window.partitionBy("block", "slot", "part").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``vectors`` (vec_id, embedding, label).

    Components count as floor(256 * x). For each row that ``anchor`` marks, its first ``positives`` other rows of the same
    label by inner product are found, and for each of these the first ``negatives`` rows of other labels whose score is from
    ``low`` to ``high`` percent of the positive's. Ties go to the smaller vec_id; of rows that repeat a vec_id each counts.
    Rows without vec_id or label, and vectors that are null or hold null or non-finite components, take no part; an empty
    vector has score 0 with all, and where lengths differ the places that both have count. Scores beyond a long are its
    ends. An empty table gives an empty result; extra columns are left out, whatever their names."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    chosen = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    chosen = chosen.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & good)
    rows = saved(chosen.select("vec_id", F.monotonically_increasing_id().alias("row"), "label", "embedding", "anchor"), "vectors")
    search = Search(rows)
    lowest, highest = F.lit(float("-inf")), F.lit(float("inf"))
    slots = F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("slot")
    every = search.anchors.select("block", slots)  # a row for each anchor
    none = F.lit(None).cast("array<array<bigint>>")

    wanted = search.anchors.select("block", lowest.alias("least"), highest.alias("most"), none.alias("wanted"))
    near = search.find(wanted, positives, True, near=True)
    kth = _first(near, positives).groupBy("block", "slot").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    least = F.min(F.when(F.col("n") >= positives, F.col("s").cast("double")).otherwise(lowest))
    wanted = every.join(kth, ["block", "slot"], "left").groupBy("block").agg(least.alias("least")).select("block", "least", highest.alias("most"), none.alias("wanted"))
    found = saved(_first(near.unionAll(search.find(wanted, positives, True)), positives), "positives")

    lists = found.groupBy("block", "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("scores"))
    whole = every.join(lists, ["block", "slot"], "left").groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "scores"))), lambda p: p["scores"]).alias("wanted"))
    # A little to spare either way covers the rounding of these ends; the windows themselves are whole numbers.
    window = lambda score: (F.col(score) * (low / 100 * (1 - 1e-12)) - 1, F.col(score) * (high / 100 * (1 + 1e-12)) + 1)
    spans = found.withColumns(dict(zip(("least", "most"), window("score"), strict=True))).where("score >= 0")
    ends = spans.groupBy("block").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    wanted = saved(ends.join(whole, "block"), "windows")
    near = search.find(wanted, negatives, False, low, high, near=True)
    kth = _first(near, negatives).groupBy("block", "slot", "part").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    spans = spans.withColumn("place", F.col("rank") - 1).select("block", "slot", F.col("place").alias("part"), "least", "most")
    spans = spans.join(kth, ["block", "slot", "part"], "left").withColumn("least", F.when(F.col("n") >= negatives, F.col("s").cast("double")).otherwise(F.col("least")))
    ends = spans.groupBy("block").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    rest = search.find(ends.join(whole, "block"), negatives, False, low, high)
    hard = _first(near.unionAll(rest), negatives).select("block", "slot", F.col("part").alias("_part"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))

    names = search.anchors.select("block", F.posexplode("names").alias("slot", "anchor_id"))
    positive = found.select("block", "slot", (F.col("rank") - 1).alias("_part"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(positive, ["block", "slot", "_part"]).join(names, ["block", "slot"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

