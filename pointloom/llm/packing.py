"""Best-fit packing by minimum bin slack.

Which pieces share a sequence depends on their lengths alone, so the plan is made from the histogram of lengths: at
most ``capacity`` numbers, however large the corpus. For one bin the largest length left is set and a bitset
subset-sum over the lengths available finds the fullest combination; it is taken as often as the counts allow and
removed. Pieces then take the places of their length in the plan by rank; ranks are counted in buckets, so a
length that a third of all pieces share is not ordered in one task."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import BUCKET_ROWS, running_total, saved
from pointloom.llm.tokens import ids_of

CAPACITY, END_ID, TOKENIZER = 1024, 2, "byte_bpe_50k.json"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document. Documents above ``capacity`` ids are cut; the first piece may be shorter."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ids_of(tokenizer, False)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    stop = first if k == 0 else start + capacity
                    part = ids[4 * start : 4 * stop]
                    for column, value in zip(rows, (doc, k, start, stop - start, zlib.crc32(part), part), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths, repeats within ``counts``, whose sum is the largest that ``room`` holds; longer ones preferred."""
    reach, steps = 1, []
    keep = (1 << (room + 1)) - 1
    for length in sorted(counts):  # the largest come last, so walking back takes them first
        if length > room:
            break
        left, many = min(counts[length], room // length), 1
        while left > 0:  # multiples by halves: log of the count many shifts
            take = min(many, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & keep
            left, many = left - take, many * 2
    best, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if best - length * take >= 0 and before >> (best - length * take) & 1:
            out += [length] * take
            best -= length * take
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): pieces of that length and rank go to sequence first + rank - first rank."""
    counts = {k: v for k, v in histogram.items() if 0 < k <= capacity and v}
    used = dict.fromkeys(counts, 0)
    places, sequence = [], 0
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        rest = fullest({k: v for k, v in counts.items() if v}, capacity - largest)
        counts[largest] += 1
        bin_ = sorted([largest, *rest], reverse=True)
        need = {k: bin_.count(k) for k in set(bin_)}
        times = min(counts[k] // n for k, n in need.items())
        offset = 0
        for length in bin_:
            places.append((length, used[length], used[length] + times, sequence, offset))
            used[length] += times
            offset += length
        for length, n in need.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        sequence += times
    return places


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset, in as few sequences of at most ``capacity`` ids as the plan finds.

    A null text is empty and yields its end id alone; rows that repeat a doc_id are packed each; an empty table
    gives an empty result. With ``with_ids`` the ids come along as little-endian unsigned 32-bit bytes."""
    pieces = saved(cut_pieces(docs, capacity, end_id, tokenizer, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    places = plan(histogram, capacity)
    parts = F.lit(max(1, sum(histogram.values()) // BUCKET_ROWS))
    ranked = pieces.select(*[c for c in pieces.columns], F.lit(1).cast("long").alias("_one"))
    ranked = ranked.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), parts)).withColumn("_order", F.struct("doc_id", "piece", F.monotonically_increasing_id().alias("n")))
    ranked = running_total(ranked, ["length"], "_bucket", ["_order"], "_one", "_rank").drop("_order", "_bucket", "_one")
    # The plan has no more places than lengths times pieces of a bin, whatever the number of rows.
    slots = docs.sparkSession.createDataFrame(places or [(0, 0, 0, 0, 0)], "_length long, _from long, _to long, _sequence long, offset long")
    rank = F.col("_rank") - 1
    found = ranked.join(F.broadcast(slots), (F.col("length") == F.col("_length")) & (rank >= F.col("_from")) & (rank < F.col("_to")))
    return found.select(*pieces.columns[:5], (F.col("_sequence") + rank - F.col("_from")).alias("sequence_id"), "offset", *pieces.columns[5:])
