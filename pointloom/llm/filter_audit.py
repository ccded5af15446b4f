"""Filter interaction audit: what each filter removes, and would have removed, at each place of each order.

Documents are first counted by part, mask of failed filters and labels; only those cells go on. Each cell is unpivoted
against the steps of all orders into a long form, a running bit-or window over the steps tells which of a cell's failures
came earlier, conditional sums give a step's figures, and a window over a filter's steps in all orders its total."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import WORD

#: Rows without doc_id are dealt out by this many salts where labels are joined.
SALTS = 1009


def failures(text: str = "text") -> dict[str, Column]:
    """The failure conditions that depend on a document's whole text alone, by letter; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(f"({WORD})"))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")) > 2 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame, tests: dict[str, Column], copies: str | None = "E") -> DataFrame:
    """(part, mask, n, good, toxic): documents by source and by the bits of the filters they fail, in the order of the
    letters of ``tests`` and then ``copies``, with how many have quality 1 and toxic 1.

    ``copies`` names the filter that fails a row whose text is also that of a smaller doc_id anywhere in the table; texts
    are equal when their SHA-256 digests and lengths are. Rows without doc_id have no smaller one and are no one's smaller
    one; rows that repeat the least doc_id all pass. Of several labels of a document any 1 counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = sum((F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests.values())), F.lit(0))
    salt = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64(text), F.lit(SALTS))).otherwise(0)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        mask.cast("int").alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("size"), salt.cast("int").alias("salt"),
    )
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_d")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")
    )
    joined = rows.join(marks.withColumn("_s", F.lit(0)), (F.col("doc_id") == F.col("_d")) & (F.col("salt") == F.col("_s")), "left")
    joined = joined.select("doc_id", "salt", "part", "mask", "digest", "size", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    kind = ["digest", "size", "part", "mask", "good", "toxic"]
    # Rows alike are one before copies meet, and copies of one part and label are one before the shuffle: what a text's
    # window holds is bounded by the number of parts, however many copies there are.
    alike = joined.groupBy("doc_id", "salt", *kind).agg(F.count("*").alias("n"))
    groups = alike.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    if copies is None:
        split = groups.select("part", "mask", "good", "toxic", "n")
    else:
        first = F.min("least").over(Window.partitionBy("digest", "size"))
        passed = F.col("nameless") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0)
        both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("passed").alias("n")), F.struct(F.col("mask").bitwiseOR(1 << len(tests)).alias("mask"), (F.col("n") - F.col("passed")).alias("n"))))
        split = groups.withColumn("passed", passed).select("part", "good", "toxic", both.alias("c")).select("part", "c.mask", "good", "toxic", "c.n").where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(cells: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders of
    ``letters`` (up to seven: orders are laid out in full). Work and rows depend on the cells, not on the documents."""
    if len(letters) > 7:
        raise ValueError("all orders of more than seven filters are too many to list")
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)]))
    long = cells.withColumn("filter_order", orders)
    long = long.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    long = long.withColumn("bit", F.pow(F.lit(2), F.instr(F.lit(letters), letter) - 1).cast("int")).withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    here, gone = F.col("failed") != 0, F.col("earlier") != 0
    total = lambda test, value="n": F.coalesce(F.sum(F.when(test, F.col(value))), F.lit(0)).cast("long")
    steps = long.groupBy("part", "filter_order", "step").agg(
        F.first("bit").alias("bit"), total(~here & ~gone).alias("kept"), total(here & ~gone).alias("removed"), total(here & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(here & ~gone, "good").alias("good_lost"), total(here & ~gone, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit")).cast("long")).drop("bit")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E by source, all 120 orders, zeros included.

    A null text counts as empty, a null source as the empty string. An empty table gives an empty result; columns other
    than doc_id, text and source (and the labels' doc_id, quality and toxic) are not looked at, whatever their names."""
    return interactions(cells(docs, labels, failures()), "ABCDE")
