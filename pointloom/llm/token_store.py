"""Token ids on disk: ORC stripes with run-length integers, row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by id before they are encoded, so each file is one task's range, written
in order; a row keeps its file's number and the ids before it in that file. Reading needs no order beyond that:
stripes are read in parallel, and the ids before each file come from two small columns."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.tokens import ids_of

END_ID, TOKENIZER = 1, "word_bpe_49k.json"
#: Rows between index entries, and the Bloom filter's rate of false positives.
INDEX_ROWS, FALSE_POSITIVES = 1000, 0.01
#: Bytes of text that one file takes.
RANGE_BYTES = 128 << 20

STORED = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> None:
    """Encodes every text (null: empty), appends ``end_id`` and writes ORC in ascending doc_id order, null ids first.

    Rows that repeat an id follow each other in any order. An empty table gives files without rows."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = ids_of(tokenizer, True), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [encoder.encode(t.as_py() or "") + end for t in batch.column(1)]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            stops = np.cumsum(n)
            offsets = np.concatenate([[0], stops]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(offsets), values)
            columns = [batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before + stops - n), pa.array(n), lists]
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])

    # As many ranges as the texts need, so that a task's share does not grow with the corpus.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(FALSE_POSITIVES), "orc.row.index.stride": str(INDEX_ROWS), "compression": "zstd"}
    rows.mapInArrow(run, STORED).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids, part, start_in_part): filters on doc_id skip stripes and row groups."""
    stored = spark.read.schema(STORED).orc(path)
    ends = stored.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("n"))
    # A row for each file; broadcast, so that ids stay where they are read.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("_before"))
    return stored.join(F.broadcast(starts), "part").withColumn("start", F.col("start_in_part") + F.col("_before")).drop("_before")


def digest(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read_tokens`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values, offsets = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B"), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
