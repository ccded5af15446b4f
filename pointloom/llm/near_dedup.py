"""MinHash near-dedup by a chosen-path set similarity join.

Every tree starts with all documents at its root. A node draws one or two of a document's minwise tokens (on average
one over the similarity sought), and each drawn token leads the document to a child; so alike documents share a
path with a probability that does not fade with depth. Paths of a fixed depth are drawn where a document is read;
nodes that still hold many documents branch on, those left small are compared exhaustively, and independent trees
are repeated until the recall sought is reached. Comparing means: first every document against the least one it met,
then, in nodes whose members are not yet connected, each against the others. Links are confirmed on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import bitmap, components, hot_join, in_bitmap, packed, saved
from pointloom.llm.shingles import mixed, shingle_set

SHINGLE, PERCENT, RECALL = 5, 75, 0.9999
#: Minwise tokens of a document, levels drawn while reading, most levels, and documents that a node may hold before it branches on.
TOKENS, DEPTH, MOST_DEPTH, SMALL = 128, 4, 6, 32
#: Levels by which a large node branches on at a time, and documents of one side where the members of a heap are compared.
JUMP, BLOCK = 2, 512
#: Documents compared with one other in one task.
STAR = 500
#: Rounds of stars before what is still apart is compared exhaustively.
STARS = 2

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 2**32, TOKENS, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, TOKENS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def survival(percent: int = PERCENT, depth: int = MOST_DEPTH, agree: float | None = None) -> float:
    """How likely two documents share a path in one tree if they agree in that share of their tokens; ``percent`` where none is given."""
    s, q = percent / 100, 1.0
    two = 1 / s - 1  # share of nodes that draw two tokens
    agree = s if agree is None else agree
    for _ in range(depth):
        q = 1 - ((1 - two) * (1 - agree * q) + two * (1 - agree * q) ** 2)
    return q


def missed(trees: int, percent: int = PERCENT, depth: int = MOST_DEPTH) -> float:
    """How likely two documents of just that similarity share no path in any tree. All trees draw from the same TOKENS,
    in which the two agree more or less often by chance, so this is the mean over what they agree in."""
    s = percent / 100
    chance = [math.comb(TOKENS, k) * s**k * (1 - s) ** (TOKENS - k) for k in range(TOKENS + 1)]
    return sum(c * (1 - survival(percent, depth, k / TOKENS)) ** trees for k, c in enumerate(chance))


def trees_for(recall: float = RECALL, percent: int = PERCENT, depth: int = MOST_DEPTH) -> int:
    """Trees that meet ``recall`` for pairs that stand in large nodes down to the last level; others meet more often."""
    trees = 1
    while missed(trees, percent, depth) > 1 - recall:
        trees += 1
    return trees


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least of each of TOKENS hashes over the set."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        part = low[at : at + 2048, None] ^ _XOR
        np.multiply(part, _MUL, out=part)
        np.minimum(out, part.min(axis=0), out=out)
    return out


def branch(nodes: np.ndarray, owner: np.ndarray, tokens: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Children of (node, document row) pairs; ``tokens`` has a row of minwise tokens for each document row."""
    draw = mixed(nodes + np.uint64(0x632BE59BD9B4E019))
    first = (draw % np.uint64(TOKENS)).astype(np.int64)
    second = ((draw >> np.uint64(8)) % np.uint64(TOKENS - 1)).astype(np.int64)
    second += second >= first
    two = (draw >> np.uint64(32)).astype(np.float64) / 2**32 < 100 / percent - 1
    nodes, owner, at = np.concatenate([nodes, nodes[two]]), np.concatenate([owner, owner[two]]), np.concatenate([first, second[two]])
    token = tokens[owner, at].astype(np.uint64) | (at.astype(np.uint64) << np.uint64(32))
    return mixed(nodes * np.uint64(0x9E3779B97F4A7C15) + mixed(token + np.uint64(1))), owner


def _read(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_a, set_b, tokens): a set's 128-bit name and its minwise tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, tokens = [], [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), shingle)
                n.append(len(s))
                a.append(int(np.add.reduce(mixed(s)).astype(np.int64)) if len(s) else 0)
                b.append(int(np.bitwise_xor.reduce(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).astype(np.int64)) if len(s) else 0)
                tokens.append(minwise(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(tokens, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, tokens binary")


def _paths(classes: DataFrame, trees: int, depth: int, percent: int) -> DataFrame:
    """(node, doc): where each class stands after the first ``depth`` levels of every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mixed(np.arange(1, trees + 1, dtype=np.uint64))
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, TOKENS)
            nodes, owner = np.tile(roots, len(rows)), np.repeat(np.arange(len(rows)), trees)
            for _ in range(depth):
                nodes, owner = branch(nodes, owner, rows, percent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.astype(np.int64)), pa.array(batch.column(0).to_numpy()[owner])], names=["node", "doc"])

    return classes.select("doc", "tokens").mapInArrow(run, "node long, doc long")


def _branch_on(members: DataFrame, levels: int, percent: int) -> DataFrame:
    """(node, doc) that many levels on, for (doc, nodes, tokens): a document's tokens come once for all its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, TOKENS)
            held = batch.column(1)
            nodes, owner = held.flatten().to_numpy().astype(np.uint64), np.repeat(np.arange(len(rows)), np.diff(held.offsets.to_numpy()))
            for _ in range(levels):
                nodes, owner = branch(nodes, owner, rows, percent)
            docs = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(nodes.astype(np.int64)), pa.array(docs[owner])], names=["node", "doc"])

    return members.select("doc", "nodes", "tokens").mapInArrow(run, "node long, doc long")


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are alike. ``texts``: (doc, text).

    Each a's text is followed by those of its b's, at most STAR in one task; one set is held at a time."""
    pairs = saved(pairs, "pairs")
    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("_stars")).withColumnRenamed("a", "_a")
    salted = pairs.join(stars, F.col("a") == F.col("_a")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("_stars")).cast("long").alias("salt"))
    members = salted.join(texts, F.col("b") == F.col("doc")).select("a", "salt", F.col("b").alias("b"), "text")
    heads = salted.select("a", "salt").distinct().join(texts, F.col("a") == F.col("doc")).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rows = members.unionAll(heads).repartition("a", "salt").sortWithinPartitions(F.col("a"), F.col("salt"), F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = shingle_set(text.as_py(), shingle)
                if b is None:
                    head = own
                    continue
                if 100 * min(len(own), len(head)) < percent * max(len(own), len(head)):
                    continue
                both = len(np.intersect1d(own, head, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(head) - both):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.select("a", "b", "text").mapInArrow(run, "a long, b long")


def _populated(level: DataFrame, hot: int) -> DataFrame:
    """(node, doc, n) of the nodes with several members; one alone has nothing to be compared with."""
    counts = level.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    return saved(hot_join(level, counts, ["node"], "n", hot).select("node", "doc", "n"), "nodes")


def _candidates(classes: DataFrame, recall: float, percent: int, hot: int) -> DataFrame:
    """(node, doc, n): the small nodes of all trees, and what stays large at the last level: alike in a great many tokens."""
    level, depth, found = _populated(_paths(classes, trees_for(recall, percent), DEPTH, percent), hot), DEPTH, []
    while True:
        found.append(level.where(F.col("n") <= SMALL))
        large = level.where(F.col("n") > SMALL)
        if depth == MOST_DEPTH or large.isEmpty():
            break
        step = min(JUMP, MOST_DEPTH - depth)
        depth += step
        nodes = large.groupBy("doc").agg(F.collect_list("node").alias("nodes"))  # as many as there are trees and branches
        level = _populated(_branch_on(nodes.join(classes.select("doc", "tokens"), "doc"), step, percent), hot)
    return reduce(DataFrame.unionAll, [*found, large])


def _apart(nodes: DataFrame, links: DataFrame, hot: int) -> DataFrame:
    """(node, doc, n, score, own) of the nodes whose members ``links`` don't connect yet; own is the component."""
    named = components(links)
    label = nodes.join(named.select(F.col("node").alias("_d"), "component"), F.col("doc") == F.col("_d"), "left").select(*nodes.columns, F.coalesce("component", "doc").alias("own"))
    several = label.groupBy("node").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("size")).where("low < high").select("node", "size")
    return saved(hot_join(label, several, ["node"], "size", hot).select(label.columns), "apart")


def _heaped(apart: DataFrame, texts: DataFrame, shingle: int, percent: int, hot: int) -> DataFrame:
    """Links (a, b) within large nodes that are still apart, each exact and enough of them to connect what is alike.

    Nodes that share members form one heap, so that no pair is compared once for each tree. What a heap's largest
    component holds is connected already: only the others, in blocks, are held against all, in blocks. A pair of blocks
    is a task, in which each document is held against the other side's inverted lists; it returns the links that join
    components, fewer than its documents. Where one block takes the others, each text is sent once more than it is read."""
    first = apart.groupBy("node").agg(F.min("doc").alias("b"), F.count("*").alias("size"))
    tied = hot_join(apart, first, ["node"], "size", hot).select(F.col("doc").alias("a"), "b")
    heaps = components(tied).select(F.col("node").alias("doc"), F.col("component").alias("heap"))
    members = saved(heaps.join(apart.groupBy("doc").agg(F.first("own").alias("own")), "doc"), "heaps")
    parts = members.groupBy("heap", "own").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("heap").agg(F.sum("n").alias("m"), F.max_by("own", F.struct("n", "own")).alias("main"), F.max("n").alias("most"))
    members = hot_join(members, sizes, ["heap"], "m", hot)
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    members = members.select("heap", "doc", "own", "main", blocks(F.col("m")).alias("all"), blocks(F.col("m") - F.col("most")).alias("others"), F.pmod(F.xxhash64("doc"), F.lit(1 << 30)).alias("h"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.where("own <> main").select("heap", F.expr("cast(h % others as int)").alias("x"), each("all").alias("y"), "doc", "own", F.lit(True).alias("left"))
    right = members.where("others > 0").select("heap", each("others").alias("x"), F.expr("cast(h % all as int)").alias("y"), "doc", "own", F.lit(False).alias("left"))
    cells = saved(left.unionByName(right), "cells")
    rows = cells.join(texts.withColumnRenamed("doc", "_d"), F.col("doc") == F.col("_d")).repartition("heap", "x", "y").sortWithinPartitions("heap", "x", "y")

    def compare(docs: list[int], own: list[int], sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        root = {c: c for c in own}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        size = np.array([len(x) for x in sets])
        flat, who = np.concatenate([sets[k] for k in right]), np.repeat(np.arange(len(right)), size[right])
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], who[order]
        out = []
        for i in left:
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(who[at], minlength=len(right))
            for j in right[100 * both >= percent * (size[i] + size[right] - both)]:
                a, b = find(own[i]), find(own[j])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((docs[i], docs[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, own, sets, sides = None, [], [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(docs) > 1:
                left, right = np.flatnonzero(sides), np.flatnonzero(~np.array(sides))
                if len(left) and len(right):
                    found = compare(docs, own, sets, left, right)
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for heap, x, y, doc, label, side, text in zip(*columns, batch.column(6), strict=True):
                if (heap, x, y) != key:
                    yield from done()
                    key, docs, own, sets, sides = (heap, x, y), [], [], [], []
                docs.append(doc)
                own.append(label)
                sets.append(shingle_set(text.as_py(), shingle))
                sides.append(side)
        yield from done()

    return rows.select("heap", "x", "y", "doc", "own", "left", "text").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept), one row per row of ``docs``.

    Documents without words, and rows without doc_id, link with nothing (component_id = doc_id). Equal sets are one
    class, compared once. Rows that repeat a doc_id are documents of their own that share an id; each is kept if its
    group's least id is that id. An empty table gives an empty result."""
    read = saved(_read(docs, shingle), "minwise")
    full = read.where("n_shingles > 0 and doc_id is not null")
    one = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("copies"))
    one = one.select("set_a", "set_b", "n_shingles", "copies", "first.doc_id", "first.text_hash").withColumn("doc", F.monotonically_increasing_id())
    classes = saved(one, "classes")
    n = classes.count()
    hot = max(SMALL + 1, n * trees_for(recall, percent) // 4000)  # a node of so many rows is one of some ten thousand at most
    tokens = read.select("doc_id", "text_hash", "tokens").dropDuplicates(["doc_id", "text_hash"])
    nodes = saved(_candidates(saved(classes.select("doc", "doc_id", "text_hash").join(tokens, ["doc_id", "text_hash"]).select("doc", "tokens"), "tokens"), recall, percent, hot), "candidates")
    wanted = nodes.select("doc").distinct().join(classes, "doc").select("doc", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    texts = saved(rows.join(wanted.hint("shuffle_hash"), (F.col("doc_id") == F.col("_d")) & (F.xxhash64("text") == F.col("_h"))).select("doc", "text").dropDuplicates(["doc"]), "texts")
    # What shares many nodes with many others is likely to be what they were copied from: a good star.
    busy = nodes.groupBy("doc").agg(F.sum("n").alias("score")).withColumnRenamed("doc", "_d")
    nodes = saved(nodes.join(busy, F.col("doc") == F.col("_d")).drop("_d"), "scored")
    links, apart = None, nodes.withColumn("own", F.col("doc"))
    for k in range(STARS):
        luck = 1 - F.pmod(F.xxhash64("doc", F.lit(k)), F.lit(1000)) / F.lit(2000.0 if k else 1e9)
        center = apart.groupBy("node").agg(F.max(F.struct((F.col("score") * luck).alias("s"), "doc", "own")).alias("c"), F.count("*").alias("size"))
        tries = hot_join(apart, center, ["node"], "size", hot).where("own <> c.own")
        pairs = tries.groupBy("doc").agg(F.max(F.struct("c.s", "c.doc")).alias("c")).select(F.col("c.doc").alias("a"), F.col("doc").alias("b"))
        new = confirm(pairs, texts, shingle, percent)
        links = saved(new if links is None else links.unionAll(new), "links")
        apart = _apart(nodes, links, hot)
    # What is still apart is compared exhaustively: small nodes as pairs across components, large ones as heaps.
    small = apart.where(F.col("n") <= SMALL)
    left, right = small.select("node", F.col("doc").alias("a"), F.col("own").alias("oa")), small.select("node", F.col("doc").alias("b"), F.col("own").alias("ob"))
    pairs = left.join(right, "node").where("a < b and oa <> ob").select("a", "b").distinct()
    links = links.unionAll(confirm(pairs, texts, shingle, percent))
    large = apart.where(F.col("n") > SMALL)
    if not large.isEmpty():
        links = links.unionAll(_heaped(large, texts, shingle, percent, hot))
    links = saved(links, "links")
    named = components(links).withColumnRenamed("node", "_d")
    joined = classes.join(named, F.col("doc") == F.col("_d"), "left").withColumn("component", F.coalesce("component", "doc"))
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("component", "_c")
    by_set = joined.join(least, F.col("component") == F.col("_c")).select("set_a", "set_b", "n_shingles", "component_id", "copies")
    known = hot_join(full, by_set, ["set_a", "set_b", "n_shingles"], "copies", full.count() // 1000 + 1).select("doc_id", "text_hash", "n_shingles", "component_id")
    alone = read.where("n_shingles = 0 or doc_id is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """``docs`` with one document of each group, the one with the least doc_id; all columns kept, whatever their names.

    Null and empty texts, and rows without doc_id, are in no group and stay. Rows that repeat the id and the text that
    stays all stay. Rows whose hash is not that of a document to drop don't move. An empty table gives an empty result."""
    gone = saved(near_groups(docs, shingle, percent, recall).where("not kept").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct(), "gone")
    rows = packed(docs).withColumn("doc", F.col("row.doc_id").cast("long")).withColumn("hash", F.xxhash64("row.text"))
    rows = in_bitmap(rows, saved(bitmap(gone, "_d", "_h"), "bits"), "doc", "hash")
    left = rows.where("maybe").join(gone, (F.col("doc") == F.col("_d")) & (F.col("hash") == F.col("_h")), "left_anti")
    return rows.where("not maybe").select("row.*").unionAll(left.select("row.*"))
