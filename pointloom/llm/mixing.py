"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id; a document's virtual finish time is its source's
words up to and with it, over the source's target; all copies are ordered by it and the order is cut at the
total budget. Within a source that order is the shuffled one, so the cut comes back as one threshold for each
source and pass: applying it to the texts needs no shuffle of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import BUCKET_ROWS, n_words, packed, running_total, saved

WEIGHTS, SHARE, REPEATS, SEED = (3, 1, 2), 1.5, 2, "mix"
#: Slices of finish time that one round of the search for the cut sums, and rows that its last slice may hold.
SLICES, LAST = 4096, 8192


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, src_no, n_docs, source_size, target): one row per source.

    Sources stand in code-point order, null last, and take the weights in turn. Targets share ``share`` of all
    words by weight and stop at ``repeats`` times the source's words; what is above is shared anew. With the
    sources in order of cap over weight that is one prefix sum: the first source whose cap holds sets the level."""
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("src_no", F.row_number().over(by_name) - 1)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("src_no") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size").cast("double") * float(repeats)).withColumn("r", F.col("cap") / F.col("w"))
    everything, before = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("r", "src_no").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    per = per.withColumn("lam", F.min_by(F.when(F.col("level") <= F.col("r"), F.col("level")), F.when(F.col("level") <= F.col("r"), F.struct("r", "src_no"))).over(everything))
    target = F.when(F.col("lam").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("lam") * F.col("w")))
    return per.select("source", "src_no", "n_docs", "source_size", target.alias("target"))


def _key(seed: str, doc_id: str, size: str) -> Column:
    """The place in the shuffled order: hash of id, id, size."""
    return F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("h"), F.col(doc_id).alias("d"), F.col(size).alias("s"))


def _cut(copies: DataFrame, budget: float) -> DataFrame:
    """The copies (at, order, size) before the point at which their running size passes ``budget``.

    The range of finish times that the cut falls into is narrowed SLICES at a time: a round sums the sizes by slice, at
    most SLICES numbers, and goes on in the slice that passes the budget. The last slice, of at most LAST rows unless
    more of them finish at once, is ordered row by row."""
    ends = copies.agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.sum("size").alias("all")).first()
    if (ends["all"] or 0) <= budget:
        return copies
    lo, hi, before, inside, reached = ends["lo"], ends["hi"], F.lit(False), F.lit(True), 0
    while True:
        width = (hi - lo) / SLICES
        slice_ = F.least(F.greatest(F.floor((F.col("at") - lo) / width), F.lit(0)), F.lit(SLICES - 1)) if width > 0 else F.lit(0)
        sums = sorted(copies.where(inside).groupBy(slice_.alias("k")).agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect())
        for k, words, n in sums:
            if reached + words > budget:
                break
            reached += words
        before, inside = before | (inside & (slice_ < k)), inside & (slice_ == k)
        if n <= LAST or len(sums) == 1:
            break
        lo, hi = lo + k * width, lo + (k + 1) * width
    ordered = Window.orderBy("order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = copies.where(inside).withColumn("end", F.sum("size").over(ordered) + F.lit(reached))
    cut = fits.where(F.col("end") <= F.lit(budget)).agg(F.max("order").alias("cut"))
    return copies.crossJoin(F.broadcast(cut)).where(before | (inside & (F.col("order") <= F.col("cut")))).drop("cut")


def cuts(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """The sizes table (doc_id, source, size, key) and, per source, its target and the last key each pass takes."""
    sizes = saved(docs.select("doc_id", "source", n_words("text").alias("size")).withColumn("key", _key(seed, "doc_id", "size")), "sizes")
    sources = saved(source_targets(sizes, weights, share, repeats), "sources")
    rows = sizes.join(sources, sizes.source.eqNullSafe(sources.source)).select("key", "size", "src_no", "n_docs", "source_size", "target")
    part = F.floor(F.conv(F.substring("key.h", 1, 8), 16, 10).cast("double") / 2.0**32 * F.ceil(F.col("n_docs") / BUCKET_ROWS))
    done = running_total(rows.withColumn("part", part), ["src_no"], "part", ["key"], "size", "cum")
    done = saved(done.select("key", "size", "src_no", "source_size", "target", "cum"), "finish")
    copies = [done.withColumn("pass", F.lit(p)).withColumn("at", (F.col("cum") + F.lit(p) * F.col("source_size")).cast("double") / F.when(F.col("target") > 0, F.col("target"))) for p in range(repeats)]
    copies = reduce(DataFrame.unionAll, copies).where(F.col("at").isNotNull()).withColumn("order", F.struct("at", "src_no", "pass", "key"))
    budget = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    copies = _cut(copies, budget)
    last = copies.groupBy("src_no").agg(*[F.max(F.when(F.col("pass") == p, F.col("key"))).alias(f"last{p}") for p in range(repeats)])
    return sizes, saved(sources.join(last, "src_no", "left"), "cuts")


def mix_digest(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): one row per row of ``docs``.

    Null text has size 0, null source is a source of its own; rows alike in id, source and size fare alike.
    The mix takes whole copies only, so it ends at or just before the budget."""
    sizes, cut = cuts(docs, weights, share, repeats, seed)
    rows = sizes.join(cut.withColumnRenamed("source", "_source"), sizes.source.eqNullSafe(F.col("_source")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * _times(repeats)).alias("taken"))


def _times(repeats: int, key: str = "key"):
    times = F.lit(0)
    for p in range(repeats):
        times = times + F.when(F.col(key) <= F.col(f"last{p}"), 1).otherwise(0)
    return times


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """The mix: rows of ``docs`` as often as it takes them, all columns kept, whatever their names. Texts stay where they are.

    Null text has size 0 and is taken with what stands before it; null source is a source of its own; rows alike in id,
    source and size fare alike. An empty table gives an empty result."""
    _, cut = cuts(docs, weights, share, repeats, seed)
    cut = cut.select(F.col("source").alias("_source"), *[F.col(f"last{p}") for p in range(repeats)])
    rows = packed(docs).withColumn("size", n_words("row.text")).withColumn("key", _key(seed, "row.doc_id", "size"))
    rows = rows.join(cut, F.col("row.source").eqNullSafe(F.col("_source")))
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), _times(repeats).cast("int"))).alias("copy")).select("row.*")
