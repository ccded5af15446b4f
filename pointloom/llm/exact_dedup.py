"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside groups.

DataFrame functions only. Hashes that repeat are noted in a bitmap of fixed size, which is broadcast; texts whose hash
is not in it are copies of nothing and never move. The others meet by their bytes: equal ones are combined before the
shuffle, so a group of copies sends one row from each task, however large it is. A bitmap holds some ten million
repeated hashes well; far beyond that it lets more and more single texts pass, which then form groups of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import bitmap, hot_join, in_bitmap, packed, saved


def _best(keep: str, doc_id: str, *more: str) -> Column:
    """The order in which the best row comes last (``max``) or first (``min``); null ids lose either way."""
    return F.struct(doc_id, *more) if keep == "max" else F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id), *more)


def exact_groups(docs: DataFrame, keep: str = "max") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    A null text counts as empty. ``keep`` says whether the largest or the smallest doc_id of equal texts stays;
    null ids count as less than any other and stay only where a group has no other. Rows that repeat both text
    and the id that stays: exactly one of them is kept. An empty table gives an empty result; extra columns are left out."""
    best = F.max if keep == "max" else F.min
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.unhex(F.md5("text")))
    hashed = saved(base.select("doc_id", "h", F.unhex(F.sha2("text", 256)).alias("s"), F.monotonically_increasing_id().alias("row")), "hashes")
    again = saved(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    bits = saved(bitmap(again, "h"), "bits")
    # Bytes are compared by grouping on the text itself; texts that share the hash but not their bytes are groups of their own.
    texts = in_bitmap(base, bits, "h").where("maybe")
    groups = texts.groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = groups.select("h", F.unhex(F.sha2("text", 256)).alias("s"), "keep_id", "group_size")
    first = in_bitmap(hashed, bits, "h").where("maybe").groupBy("h", "s").agg(best(_best(keep, "doc_id", "row")).alias("b")).select("h", "s", F.col("b.row").alias("keep_row"))
    groups = saved(groups.join(first, ["h", "s"]), "groups")
    joined = hot_join(hashed, groups, ["h", "s"], "group_size", hashed.count() // 1000 + 1, left=True)
    return joined.select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), F.lower(F.hex("s")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """``docs`` with one row for each text, all columns kept, whatever their names.

    A null text counts as empty and stays null where its row stays. Of rows that tie in text and id any one stays; null
    ids lose to others. An empty table gives an empty result."""
    best = F.max_by if keep == "max" else F.min_by
    rows = packed(docs).withColumn("text", F.coalesce("row.text", F.lit(""))).withColumn("h", F.unhex(F.md5("text")))
    again = saved(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    rows = in_bitmap(rows, saved(bitmap(again, "h"), "bits"), "h")
    # The text is the key; the row that goes along leaves it out but for whether it was null.
    rest = F.struct(F.col("row.text").isNull().alias("none"), F.col("row").dropFields("text").alias("row")) if len(docs.columns) > 1 else F.struct(F.col("row.text").isNull().alias("none"))
    one = rows.where("maybe").groupBy("h", "text").agg(best(rest, _best(keep, "row.doc_id")).alias("best"))
    columns = [F.when(F.col("best.none"), None).otherwise(F.col("text")).alias(c) if c == "text" else F.col(f"best.row.`{c}`").alias(c) for c in docs.columns]
    return rows.where("not maybe").select("row.*").unionAll(one.select(*columns))
