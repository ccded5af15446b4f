"""Cutting lineage in loops: a Parquet table in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A local session that names none gets a folder of its own; on a cluster such a folder
    would be lost with its machine, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pointloom/cut-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pointloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``cut`` wrote, once nothing lazy depends on it: loops must not fill the folder."""
    for df in frames:
        if path := getattr(df, "_pointloom_path", None):
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)
