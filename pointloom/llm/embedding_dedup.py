"""Embedding near-dedup by a forest of random-projection trees with spill.

Each tree splits the unit vectors again and again at the median of a random projection; a fixed share of a node's vectors,
those nearest to the cut, goes to both sides. Directions are random mixtures of a sample's vectors, so they lie where the
vectors spread; cuts and shares are quantiles of the node's own sample, wherever the vectors' common mean is. The band that
goes to both sides is never narrower than near copies are apart, and a node that spreads no wider than linked vectors do
is not split: nearly all of its pairs are links. Every vector is sent down every tree and vectors are compared within leaves in double precision. How many trees there are
follows from made pairs of the very cosine sought, which are sent down a tree. A leaf that stays large is cut into
blocks, and each pair of blocks is a task of its own. A pair of vectors counts in the first leaf that both share; what goes
on is a count for each vector and the links of a spanning forest, never all pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import components, drawn, hot_join, saved

#: RECALL is sought for pairs of exactly the cosine; pairs that are closer meet more surely.
COSINE, RECALL, SEED = 0.9, 0.995, 7
#: Vectors that fit the splits (fewer if they are long), numbers they hold, vectors of a leaf on average, of a block.
SAMPLE, NUMBERS, LEAF, BLOCK = 50_000, 1 << 23, 1600, 1000
#: The share of a node that goes to both sides, sampled vectors that a fitted node has at least, trees at most.
SHARE, FITTED, MOST_TREES = 0.08, 32, 64
#: Half the least width of the band that goes both ways, in spreads of what tells vectors of the very cosine apart.
NEAR = 0.2


class Forest:
    """A direction for each tree and level; cuts and the band that goes both ways by node, for nodes below the fitted levels
    those of the fitted node above, as random directions split alike all that it holds."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int | None = None, recall: float = RECALL, cosine: float = COSINE, seed: int = SEED) -> None:
        self.rng, self.depth = np.random.default_rng(seed), depth
        self.apart = math.sqrt(max(0.0, 2 - 2 * cosine) / max(1, sample.shape[1]))
        self.middle = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
        self.fitted = max(0, min(depth, int(math.log2(max(1, len(sample)) / FITTED)) if len(sample) else 0))
        self.directions: list[np.ndarray] = []
        self.bands: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        met = []
        while len(self.directions) < (trees or 1) or (trees is None and depth and self._wanted(met, recall) > len(self.directions)):
            self._grow(sample)
            met.append(self._met(sample, cosine) if trees is None and depth else 1.0)
        self.trees = len(self.directions)

    @staticmethod
    def _wanted(met: list[float], recall: float) -> int:
        """Trees that bring a pair together at least once with probability ``recall``, at most MOST_TREES."""
        together = min(max(float(np.mean(met)), 1e-6), 1 - 1e-9)
        return min(MOST_TREES, max(2, math.ceil(math.log(1 - recall) / math.log(1 - together))))

    def _grow(self, sample: np.ndarray) -> None:
        mix = self.rng.standard_normal((self.depth, len(sample))) @ (sample - self.middle) if len(sample) > 1 else self.rng.standard_normal((self.depth, sample.shape[1]))
        directions = mix / np.maximum(np.linalg.norm(mix, axis=1, keepdims=True), 1e-300)
        nodes, levels = np.zeros(len(sample), np.int64), []
        for level in range(self.depth):
            p = sample @ directions[level]
            order = np.lexsort((p, nodes))
            at = np.searchsorted(nodes[order], np.arange(2 ** min(level, self.fitted) + 1))
            size = np.diff(at)
            place = lambda share: p[order][np.minimum(at[:-1] + np.floor(share * size).astype(np.int64), np.maximum(at[1:] - 1, 0))] if len(p) else np.zeros(len(size))  # noqa: B023, E731
            cut, spread = place(0.5), (place(0.84) - place(0.16)) / 2
            low, high = np.minimum(place(0.5 - SHARE / 2), cut - NEAR * self.apart), np.maximum(place(0.5 + SHARE / 2), cut + NEAR * self.apart)
            whole = spread < self.apart
            levels.append(tuple(np.where(whole, -np.inf, x) for x in (cut, low, high)))
            if level < self.fitted:
                nodes = 2 * nodes + (p >= levels[-1][0][nodes])
        self.directions.append(directions)
        self.bands.append(levels)

    def _met(self, sample: np.ndarray, cosine: float, pairs: int = 1000) -> float:
        """The share of made pairs, sampled vectors and others of the very cosine, that meet in the last tree."""
        own = sample[self.rng.integers(0, len(sample), pairs)]
        away = self.rng.standard_normal(own.shape)
        away -= (away * own).sum(axis=1, keepdims=True) * own
        other = cosine * own + math.sqrt(1 - cosine * cosine) * away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        (a, i), (b, j) = self._down(own, len(self.directions) - 1), self._down(other, len(self.directions) - 1)
        return len(np.unique(np.intersect1d(a * pairs + i, b * pairs + j) % pairs)) / pairs

    def _down(self, unit: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        rows, nodes = np.arange(len(unit)), np.zeros(len(unit), np.int64)
        for level, (cut, low, high) in enumerate(self.bands[tree]):
            p, node = (unit @ self.directions[tree][level])[rows], nodes >> max(0, level - self.fitted)
            side = (p >= cut[node]).astype(np.int64)
            near = (p >= low[node]) & (p < high[node])
            rows, nodes = np.concatenate([rows, rows[near]]), np.concatenate([2 * nodes + side, 2 * nodes[near] + 1 - side[near]])
        return nodes, rows

    def leaves(self, unit: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(tree, leaf, row) for each tree; a row comes up in every leaf it spills into."""
        for t in range(self.trees):
            yield t, *self._down(unit, t)


def unit_rows(a: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component goes out first, so that no square under- or overflows."""
    a = a / np.maximum(np.abs(a).max(axis=1, keepdims=True, initial=0), np.finfo(np.float64).tiny)
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), np.finfo(np.float64).tiny)


def _unit(rows: pa.Array) -> np.ndarray:
    a = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit_rows(a.reshape(len(rows), -1) if len(rows) else np.zeros((0, 1)))


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of (i, j) that tie together what all of them do."""
    root, out = list(range(n)), []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _compared(v: np.ndarray, left: np.ndarray, same: bool, copies: np.ndarray, leaves: list[np.ndarray], leaf: int, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(what each row's links count, links that span them) of one pair of blocks. A pair that shares a lower leaf counted there."""
    count = np.zeros(len(v), np.int64)
    a, b = (np.arange(len(v)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
    linked = v[a] @ v[b].T >= cosine
    if same:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return count, []
    x, y = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    rows = np.unique(np.concatenate([a[x], b[y]]))
    lower = [own[own < leaf] for own in (leaves[r] for r in rows)]
    names = np.unique(np.concatenate(lower))
    member = np.zeros((len(v), len(names)), np.float32)
    for r, own in zip(rows, lower, strict=True):
        member[r, np.searchsorted(names, own)] = 1
    linked = linked[np.ix_(x, y)] & (member[a[x]] @ member[b[y]].T == 0)
    count[a[x]] += linked @ copies[b[y]]
    if not same:
        count[b[y]] += copies[a[x]] @ linked
    i, j = np.nonzero(linked)
    return count, spanning(len(v), a[x][i], b[y][j])


def similar_classes(classes: DataFrame, dim: int, n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(id, others): how many vectors beside its own each of ``classes`` (id, embedding, copies) of ``dim`` components links
    with, rows of an id to be summed; and (a, b): links that tie together all that are linked."""
    depth = max(0, math.ceil(math.log2(max(1, n) / LEAF)))
    sample = [r[0] for r in drawn(classes.select("id", "embedding"), max(1, min(SAMPLE, NUMBERS // max(1, dim))), "id").orderBy("id").select("embedding").collect()] if depth else []
    forest = Forest(unit_rows(np.array(sample, np.float64).reshape(len(sample), dim)), depth, None if depth else 1, recall, cosine)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column(1))
            leaf, row = (np.concatenate(x) for x in zip(*[(leaf * forest.trees + tree, row) for tree, leaf, row in forest.leaves(unit)], strict=True))
            by = np.lexsort((leaf, row))
            counts = np.bincount(row, minlength=len(unit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(leaf[by]))], names=["id", "leaves"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                ids, blocks, copies, leaves, vectors = (list(x) for x in zip(*held, strict=True))
                ids = np.array(ids)
                count, links = _compared(unit_rows(np.array(vectors, np.float64)), np.array(blocks) == key[1], key[1] == key[2], np.array(copies, np.int64), leaves, key[0], cosine)
                some = np.flatnonzero(count)
                a, b = ids[some], np.array([(ids[i], ids[j]) for i, j in links], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b[:, 0]])), pa.array([None] * len(a) + b[:, 1].tolist(), pa.int64()), pa.array(np.concatenate([count[some], np.zeros(len(b), np.int64)]))], names=["a", "b", "others"])

        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True))
            rest = zip(*[batch.column(k).to_pylist() for k in (3, 4, 5)], batch.column(6), batch.column(7), strict=True)
            for k, (own, block, copies, leaves, vector) in zip(keys, rest, strict=True):
                if k != key:
                    yield from found()
                    key, held = k, []
                held.append((own, block, copies, leaves.values.to_numpy(), vector.values.to_numpy(zero_copy_only=False)))
        yield from found()

    placed = saved(classes.select("id", "embedding").mapInArrow(send, "id long, leaves array<long>"), "leaves")
    each = placed.select("id", F.explode("leaves").alias("leaf"))
    sizes = each.groupBy("leaf").agg(F.count("*").alias("m")).where("m > 1")
    blocks = each.join(sizes, "leaf").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A row meets each block of its leaf once; the lower block stands first.
    cells = blocks.select("leaf", "id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("leaf", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "block")
    cells = cells.join(classes.select("id", "copies", "embedding").join(placed, "id"), "id")
    ordered = cells.repartition("leaf", "x", "y").sortWithinPartitions("leaf", "x", "y")
    found = saved(ordered.select("leaf", "x", "y", "id", "block", "copies", "leaves", "embedding").mapInArrow(compare, "a long, b long, others long"), "found")
    return found.where("b is null").select(F.col("a").alias("id"), "others"), found.where("b is not null").select("a", "b")


def embedding_groups(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing. Equal vectors are
    one class and link with each other; vectors of other lengths never link. Rows that repeat a vec_id are vectors of
    their own. An empty table gives an empty result."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", F.coalesce(good, F.lit(False)).alias("good"))
    classes = rows.where("good").groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")).withColumn("id", F.monotonically_increasing_id())
    classes = saved(classes.withColumn("dim", F.size("embedding")), "classes")
    found = [similar_classes(classes.where(F.col("dim") == dim), dim, n, cosine, recall) for dim, n in classes.groupBy("dim").count().collect()]  # a row for each length of vectors
    counts, links = (vectors.sparkSession.createDataFrame([], schema) for schema in ("id long, others long", "a long, b long"))
    for more, tied in found:
        counts, links = counts.unionAll(more), links.unionAll(tied)
    degree = counts.groupBy("id").agg(F.sum("others").alias("others"))
    named = components(links).withColumnRenamed("node", "id")
    full = classes.join(degree, "id", "left").join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = full.groupBy("component").agg(F.min("least").alias("component_id"))
    full = full.join(least, "component").select("embedding", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    known = hot_join(rows.where("good"), full, ["embedding"], "copies", rows.count() // 1000 + 1).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
