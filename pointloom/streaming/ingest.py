"""Streams of points: voxel thinning within a watermark, session windows, and appending to a layer exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointloom.functions.columns import cell


def thin_stream(points: DataFrame, spacing: float, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first point of each voxel seen within the watermark; state is dropped behind it."""
    keys = [cell(F.col(c), spacing).alias(f"v{c}") for c in "xyz"]
    return points.select("*", *keys).withWatermark(time, late).dropDuplicatesWithinWatermark(["vx", "vy", "vz"]).drop("vx", "vy", "vz")


def sessions(events: DataFrame, key: str, gap: str = "5 minutes", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(key, start, end, n) of bursts no further apart than ``gap``."""
    out = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_layer(points: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to a Parquet layer under its number, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return points.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
