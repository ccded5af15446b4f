"""Clouds out of relational tables: gid, x, y, z and the fields an operator reads. Only the columns used are scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    axes = [F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")]
    return rows.select(F.col("vec_id").alias("gid"), *axes, F.col("label").cast("int").alias("cls"))


def cloud_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return rows.select(F.col("o_orderkey").alias("gid"), (F.col("o_totalprice") / 1000).alias("x"), (days / 10.0).alias("y"), (F.col("o_custkey") % 100).cast("double").alias("z"), F.col("o_orderstatus").alias("status"))


def cloud_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    first = rows.agg(F.min("ts").alias("first"))  # one row
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1e6
    return rows.crossJoin(F.broadcast(first)).select(F.col("event_id").alias("gid"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"), seconds.alias("z"), F.col("event_type").alias("kind"))


def cloud_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.col("l_extendedprice").alias("z"), F.col("l_returnflag").alias("flag"))
