"""Chat formatting: cumulative-snapshot collapse, then rendering. DataFrame functions only.

A logged conversation that another one continues is a snapshot of it. Each turn gets a hash of its place, role
and text; the running xor of these names every prefix of every conversation, so a snapshot's whole hash occurs
among the proper prefixes of longer conversations, and an anti-join leaves the maximal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import running_total, same, saved

#: Turns of one conversation that one task orders, and that one rendered row holds.
PART_TURNS = 1024
#: The markers around a rendered turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, part, role, text, h1, h2): place counts from 1, h1 and h2 name the conversation up to it."""
    rows = turns.select("conv_id", "turn", "role", "text", F.lit(1).cast("long").alias("_one"))
    rows = rows.withColumn("_chunk", F.floor(F.col("turn") / PART_TURNS))
    # Turns that tie in number, role and text are alike; a row number within the tie keeps places apart.
    chunk = Window.partitionBy("conv_id", "_chunk").orderBy("turn", "role", "text")
    rows = rows.withColumn("_local", F.row_number().over(chunk)).withColumn("_order", F.struct("turn", "_local"))
    rows = running_total(rows, ["conv_id"], "_chunk", ["_order"], "_one", "place").drop("_order", "_local", "_one", "_chunk")
    rows = rows.withColumn("part", F.floor((F.col("place") - 1) / PART_TURNS).cast("long"))
    tag = F.concat(F.when(F.col("role").isNull(), "n").otherwise("v"), F.when(F.col("text").isNull(), "n").otherwise("v"))
    rows = rows.withColumn("_x1", F.xxhash64("place", "role", "text", tag)).withColumn("_x2", F.xxhash64(tag, "text", "place", "role", F.lit("second")))
    sums = rows.groupBy("conv_id", "part").agg(F.bit_xor("_x1").alias("_s1"), F.bit_xor("_x2").alias("_s2"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), *[F.coalesce(F.bit_xor(f"_s{k}").over(before), zero).alias(f"_b{k}") for k in (1, 2)])
    within = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, same({"conv_id": "_c", "part": "_p"}))
    return rows.select("conv_id", "place", "part", "role", "text", *[F.col(f"_b{k}").bitwiseXOR(F.bit_xor(f"_x{k}").over(within)).alias(f"h{k}") for k in (1, 2)])


def maximal(named: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that none continues; of equal ones the smallest id."""
    ends = named.groupBy("conv_id").agg(F.max("place").alias("n_turns"), F.max_by(F.struct("h1", "h2"), "place").alias("h"))
    whole = ends.groupBy("n_turns", "h").agg(F.min("conv_id").alias("conv_id"))
    names = named.select("conv_id", "place", F.struct("h1", "h2").alias("h"))
    longer = ends.select(F.col("conv_id").alias("_c"), F.col("n_turns").alias("_n"))
    proper = names.join(longer, same({"conv_id": "_c"})).where("place < _n").select(F.col("place").alias("n_turns"), "h").distinct()
    return whole.join(proper, ["n_turns", "h"], "left_anti").select("conv_id", "n_turns")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, text): each maximal conversation rendered, in rows of up to PART_TURNS turns.

    Turns stand by number; ties by role, then text, nulls first. Null role and text render as empty but differ
    from empty in the comparison; rows without conv_id are one conversation, and of equal conversations an id
    beats none. An empty table gives an empty result; other columns are left out."""
    named = saved(prefixes(turns), "prefixes")
    kept = saved(maximal(named), "maximal").withColumnRenamed("conv_id", "_c")
    rows = named.join(kept, same({"conv_id": "_c"})).drop("_c")
    turn = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    rows = rows.groupBy("conv_id", "part", "n_turns").agg(F.array_sort(F.collect_list(F.struct("place", turn.alias("turn")))).alias("_turns"))
    return rows.select("conv_id", "part", "n_turns", F.array_join(F.col("_turns.turn"), "").alias("text"))
