"""What the training-data operators share: tables, saved intermediates, words, prefix sums, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.plans.lineage import discard, shared_dir
from pointloom.plans.stars import components

__all__ = ["components", "discard", "shared_dir"]  # used by the operators beside what is defined here

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one bucket of a distributed prefix sum holds on average.
BUCKET_ROWS = 4096
#: Words of 64 bits in a bitmap of hashes: its size is bound, whatever it holds.
BITMAP_WORDS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/pointloom/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet into the shared folder and reads it back.

    The files outlive any executor, so a later failure recomputes nothing before this point."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pointloom_path = path
    return out


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs run inside send Python at most ``most`` rows at once: for rows that hold whole blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct ``row``, so that no name an operator uses can clash with a column; ``row.*`` unpacks it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def bitmap(rows: DataFrame, *key: str) -> DataFrame:
    """(_word, _bits): which hashes of ``key`` occur; at most BITMAP_WORDS rows, combined before the shuffle."""
    at = F.xxhash64(*key)
    spots = rows.select(F.pmod(at, F.lit(BITMAP_WORDS)).alias("_word"), F.shiftrightunsigned(at, 58).cast("int").alias("_bit"))
    return spots.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))


def in_bitmap(rows: DataFrame, bits: DataFrame, *key: str) -> DataFrame:
    """Adds ``maybe``: false only where the key is surely not among those of ``bits``. The rows stay where they are."""
    at = F.xxhash64(*key)
    met = rows.join(F.broadcast(bits), F.pmod(at, F.lit(BITMAP_WORDS)) == F.col("_word"), "left")
    return met.withColumn("maybe", F.coalesce(F.getbit("_bits", F.shiftrightunsigned(at, 58).cast("int")) == 1, F.lit(False))).drop("_word", "_bits")


def drawn(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """All of ``rows`` while they are at most ``most``; beyond that, of each of ``most`` shares of the hashes of ``key`` the row
    with the least one. ``rows`` are counted first.

    Minima are taken before the shuffle, so no task and no driver ever holds more, however many partitions there are."""
    if rows.count() <= most:
        return rows
    at = F.xxhash64(*key, F.lit("drawn"))
    one = rows.groupBy(F.pmod(at, F.lit(most)).alias("_share")).agg(F.min_by(F.struct(*rows.columns), at).alias("_row"))
    return one.select("_row.*")


def hot_join(rows: DataFrame, groups: DataFrame, key: list[str], size: str, hot: int, left: bool = False) -> DataFrame:
    """``rows`` joined to ``groups``, which has a row for each key and in ``size`` how many rows share it.

    Keys of ``hot`` rows and more are broadcast: with ``hot`` a thousandth of all rows there are at most a thousand of
    them. Their rows then go through the shuffle for the others by a hash of the whole row, so no key's rows meet in
    one task, and ``rows`` are computed once. Unmatched rows stay if ``left``."""
    more = [c for c in groups.columns if c not in key]
    sides = {tag: groups.select(*[F.col(k).alias(f"{tag}k{i}") for i, k in enumerate(key)], *[F.col(c).alias(f"{tag}_{c}") for c in more], F.lit(True).alias(f"{tag}met")) for tag in ("_h", "_c")}
    met = rows.join(F.broadcast(sides["_h"].where(F.col(f"_h_{size}") >= hot)), same({k: f"_hk{i}" for i, k in enumerate(key)}), "left")
    met = met.withColumn("_salt", F.when(F.col("_hmet"), 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1009))).otherwise(0))
    met = met.withColumns({f"_k{i}": F.when(F.col("_hmet").isNull(), F.col(k)) for i, k in enumerate(key)})
    cold = sides["_c"].where(F.col(f"_c_{size}") < hot).withColumn("_none", F.lit(0).cast("long"))
    out = met.join(cold, same({f"_k{i}": f"_ck{i}" for i in range(len(key))}) & (F.col("_salt") == F.col("_none")), "left")
    out = out if left else out.where("_hmet or _cmet")
    return out.select(*rows.columns, *[F.when(F.col("_hmet"), F.col(f"_h_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in more])


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds the inclusive running total of ``value`` within ``group`` (peers of equal order share it), without one task per group.

    ``bucket`` must rise with ``order`` within a group; each bucket is summed first, the small table of
    bucket sums is accumulated, and only a bucket's own rows are ordered in one task."""
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    within = Window.partitionBy(*keys).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    joined = df.join(sums, same({k: f"_k{i}" for i, k in enumerate(keys)}))
    return joined.withColumn(out, F.col("_before") + F.sum(value).over(within)).drop("_before", *[f"_k{i}" for i in range(len(keys))])


def same(names: dict[str, str]) -> Column:
    """Equal columns, nulls equal too."""
    on = F.lit(True)
    for a, b in names.items():
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on
