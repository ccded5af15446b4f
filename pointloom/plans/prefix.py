"""Running totals without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.columns import joined, split

#: Ids that one bucket spans.
BUCKET = 4096


def running_total(rows: DataFrame, order: str, value: str, out: str, bucket: int = BUCKET, start: str | None = None) -> DataFrame:
    """Adds the inclusive running total of ``value`` in the order of the whole number ``order``, and as ``start`` the one before it.

    Ranges of ``bucket`` ids are summed first; their sums, a row for each range, are accumulated; only a range's own
    rows are ordered in one task. Totals are of whole-number parts, so they do not depend on how rows are dealt."""
    parts = [f"_p{k}" for k in range(4)]
    rows = rows.withColumn("_part", F.floor(F.col(order) / bucket)).withColumns(dict(zip(parts, split(F.col(value)), strict=True)))
    sums = rows.groupBy("_part").agg(*[F.sum(p).alias(p) for p in parts])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(p).over(before), F.lit(0)).alias(f"{p}_before") for p in parts])
    window = Window.partitionBy("_part").orderBy(order)
    met = rows.join(sums, F.col("_part") == F.col("_p"))
    total = lambda end: joined([F.col(f"{p}_before") + F.coalesce(F.sum(p).over(window.rowsBetween(Window.unboundedPreceding, end)), F.lit(0)) for p in parts])
    return met.withColumns({out: total(Window.currentRow)} | ({start: total(-1)} if start else {})).drop("_part", "_p", *parts, *[f"{p}_before" for p in parts])
