"""Connected components by alternating stars, plain and with a sign along each edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pointloom.plans.lineage import cut, discard


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b): the smallest node reachable.

    Alternates large-star and small-star steps, each a shuffle on node ids, until the edges no longer change; the number
    of rounds grows with the logarithm of the longest path. Every round is written and the one before deleted. Steps
    only take minima over a node's neighbours, combined before the shuffle, so a node with very many is no hot key."""
    first = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, last = _marked(first)
    while True:
        # large star: every larger neighbour of u is tied to the least of u and its neighbours
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours are tied to the least of them
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        after, mark = _marked(small.where("u <> v"))
        discard(edges)
        edges = after
        if last == mark:
            break
        last = mark
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges, written, with their number and a sum over their hashes, taken while they are written."""
    seen = Observation()
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
    out = cut(edges.distinct().observe(seen, *mark))
    found = seen.get
    return out, (found.get("n"), found.get("h"))


def signed_components(links: DataFrame) -> DataFrame:
    """(node, component, sign) for the nodes of ``links`` (a, b, weight): the smallest node reachable, and the product of signs
    on the way to it, 1 or -1, where a link's sign is that of its weight.

    The same stars as ``components``, each edge with the sign of the way that it stands for; so rounds grow with the logarithm
    of the longest path. Ways of both signs between two nodes, where signs disagree around a cycle, are one edge of the sign
    that weighs more (ties: 1); a way weighs as much as its weaker part. The component itself has sign 1."""
    way = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.col("weight").cast("double").alias("w")
    edges, last = _signed(links.where("a <> b").select(*way))
    while True:
        both = edges.select("u", "v", "w").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
        through = lambda: F.least(F.abs("w"), F.abs("mw")) * F.signum("w") * F.signum("mw")
        least = both.groupBy("u").agg(F.min(F.struct("v", "w")).alias("m")).select("u", "m.v", "m.w").withColumnsRenamed({"u": "_u", "v": "m", "w": "mw"})
        met = both.where("v > u").join(least, F.col("u") == F.col("_u"))
        large = _merged(met.select(F.col("v").alias("u"), F.when(F.col("m") < F.col("u"), F.col("m")).otherwise(F.col("u")).alias("v"), F.when(F.col("m") < F.col("u"), through()).otherwise(F.col("w")).alias("w")))
        low = large.groupBy("u").agg(F.min(F.struct("v", "w")).alias("m")).select("u", "m.v", "m.w").withColumnsRenamed({"u": "_u", "v": "m", "w": "mw"})
        small = large.join(low, F.col("u") == F.col("_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"), through().alias("w"))
        after, mark = _signed(small.unionAll(low.select(F.col("_u").alias("u"), F.col("m").alias("v"), F.col("mw").alias("w"))))
        discard(edges)
        edges = after
        if last == mark:
            break
        last = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"), F.when(F.col("w") < 0, -1).otherwise(1).alias("sign")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"), F.lit(1).alias("sign")).distinct()
    )


def _merged(edges: DataFrame) -> DataFrame:
    """One edge for each pair of nodes, of the sign that weighs more."""
    return edges.groupBy("u", "v").agg(F.sum("w").alias("s"), F.max(F.abs("w")).alias("most")).select("u", "v", F.when(F.col("s") == 0, F.col("most")).otherwise(F.col("s")).alias("w"))


def _signed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The merged edges, written, and a mark of which there are."""
    seen = Observation()
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
    out = cut(_merged(edges).observe(seen, *mark))
    found = seen.get
    return out, (found.get("n"), found.get("h"))
