"""Substring dedup by recompression.

Words get names; every step names runs of one symbol, then pairs of neighbours (left and right kinds are told by a bit
of the name), so symbols grow with each step. A name is a hash of what it stands for: all tasks name alike, and no
table of names has to be joined back to every place of the corpus. Equal substrings get equal symbols but near their
ends. Each symbol knows the words that decide it; where they all lie inside a window of ``window`` words, every copy of
that window has the symbol too. A window takes one of its highest symbols, the least by name, as its anchor, and
neighbouring windows with one anchor are one span.

Spark rounds over the names find what is shared. A round counts, over all documents, in which each anchor occurs; spans
whose anchor only one document has are done. What is left is recompressed further, so that longer symbols, which stand
for most of a window, are its anchors, and counted anew. The spans that come out are verified by 128-bit digests of
their very words: spans equal to a span of a smaller document go as a whole; the first copy of each distinct span that
shares its anchor with others has its windows digested one by one. So long repeats cost a row for each span, not for
each window. Anchors, spans and windows that a great many documents share are joined by broadcast, not in one task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import bitmap, discard, hot_join, in_bitmap, saved
from pointloom.llm.shingles import mixed, word_hashes

WINDOW = 50
#: Steps of naming runs and pairs before each Spark round over the names. After three, symbols have two to three words,
#: some fifteen of them decided inside a window; after five they are decided by most of a window's words.
STEPS = (3, 5)
#: Words that are worked on at once; a longer document is worked on alone.
CHUNK_WORDS = 400_000

_U = np.uint64
_R1, _R2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd: names of pairs and runs
_PLACE = _U((1 << 30) - 1)


def _inverse(r: int) -> int:
    return pow(r, -1, 1 << 64)


def _powers(r: int, n: int) -> np.ndarray:
    out = np.full(n, r, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Prints:
    """64-bit fingerprints of ranges of word hashes by prefix sums. They name symbols; what they say is verified."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.sums, self.back = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_R1, n))]), _powers(_inverse(_R1), n + 1)

    def of(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[first]) * self.back[first])


class Digests:
    """128-bit digests of the very words, joined by one space, of ranges of a text."""

    def __init__(self, text: bytes) -> None:
        words = text.split()
        self.bytes = memoryview(b" ".join(words))
        self.at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]).tolist()

    def of(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Two 64-bit halves for each range."""
        found = [xxhash.xxh3_128_digest(self.bytes[self.at[f] : self.at[s] - 1]) for f, s in zip(first.tolist(), stop.tolist(), strict=True)]
        return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)


Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def recompress(names: np.ndarray, fixed: np.ndarray, steps: int) -> list[Level]:
    """(names, lo, hi) of the symbols after each step from STEPS[0] to ``steps``: words lo to hi decide that symbol.
    ``fixed`` symbols never join others."""
    levels = []
    lo = np.arange(len(names))
    hi = lo + 1
    for k in range(steps):
        # Runs: a symbol is alone, or its run ends, only by what its neighbours are.
        first = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | fixed[1:]]))
        count = np.diff(np.concatenate([first, [len(names)]]))
        last = first + count - 1
        lo, hi = lo[np.maximum(first - 1, 0)], hi[np.minimum(last + 1, len(names) - 1)]
        names, fixed = names[first], fixed[first]
        runs = count > 1
        names = np.where(runs, mixed(names * _U(_R2) + mixed(count.astype(np.uint64))), names)
        # Pairs: a left kind joins the right kind behind it.
        kind = ((mixed(names + _U(k + 1)) >> _U(40)) & _U(1)).astype(np.int8)
        kind[fixed] = 2
        joins = np.concatenate([(kind[:-1] == 0) & (kind[1:] == 1), [False]])
        second = np.concatenate([[False], joins[:-1]])
        right, left = np.minimum(np.arange(len(names)) + 1, len(names) - 1), np.maximum(np.arange(len(names)) - 1, 0)
        names = np.where(joins, mixed(names * _U(_R1) + mixed(names[right] ^ _U(0xA0761D6478BD642F))), names)
        lo, hi = np.where((kind == 1) & ~second, lo[left], lo), np.where(kind == 0, hi[right], hi)
        names, fixed, lo, hi = names[~second], fixed[~second], lo[~second], hi[~second]
        if k + 1 >= STEPS[0]:
            levels.append((names, lo, hi))
    return levels


def _anchors(level: Level, first: np.ndarray, window: int, n: int) -> np.ndarray:
    """The least symbol of a level that is decided inside each window, or -1."""
    names, lo, hi = level
    # The symbols decided inside a window are those from a to b, as lo and hi rise.
    a = np.concatenate([[0], np.cumsum(np.bincount(lo, minlength=n))])[first]
    b = np.cumsum(np.bincount(hi, minlength=n + 1))[first + window]
    table = (mixed(names ^ _U(0x2545F4914F6CDD1D)) & ~_PLACE) | np.arange(len(names)).astype(np.uint64)
    size, anchor, step = b - a, np.full(len(first), -1, np.int64), 1
    top = int(size.max(initial=0))
    while step <= top:
        now = np.flatnonzero((size >= step) & (size < 2 * step))
        if len(now):
            anchor[now] = (np.minimum(table[a[now]], table[b[now] - step]) & _PLACE).astype(np.int64)
        table = np.minimum(table[:-step], table[step:]) if len(table) > step else table
        step *= 2
    return anchor


def spans(texts: list[bytes], asked: list[np.ndarray | None], steps: int, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(row, name, first, count): neighbouring windows of a text that share an anchor, among the windows ``asked`` of it
    (None: all). The highest symbols decided inside a window come first, so its copies take the same anchor.

    A window in which no symbol is decided, as inside a long run, is a span by itself, named by its fingerprint."""
    words, rows, firsts, begins, at = [], [], [], [], 1
    for k, (text, own) in enumerate(zip(texts, asked, strict=True)):
        w = word_hashes(text)
        if len(w) >= window:
            words += [np.zeros(1, np.uint64), w]  # a place between texts that belongs to none
            rows.append(k)
            begins.append(at)
            firsts.append((np.arange(len(w) - window + 1) if own is None else own) + at)
            at += len(w) + 1
    if not rows:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    flat = np.concatenate([*words, np.zeros(1, np.uint64)])
    fixed = np.zeros(len(flat), bool)
    fixed[np.array(begins) - 1] = fixed[-1] = True
    first, owner = np.concatenate(firsts), np.repeat(np.arange(len(rows)), [len(f) for f in firsts])
    prints, key = Prints(flat), np.zeros(len(first), np.uint64)
    left = np.arange(len(first))
    for k, level in reversed(list(enumerate(recompress(flat, fixed, steps)))):
        anchor = _anchors(level, first[left], window, len(flat))
        names, lo, hi = level
        what, found = anchor[anchor >= 0], left[anchor >= 0]
        # An anchor goes by all the words that decide it: by its own few words alone, common phrases would be shared names.
        key[found] = mixed(prints.of(lo[what], hi[what]) ^ names[what] ^ _U(k)) | _U(1)
        left = left[anchor < 0]
    alone = np.zeros(len(first), bool)
    alone[left] = True
    key[left] = prints.of(first[left], first[left] + window)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | alone[1:] | alone[:-1] | (owner[1:] != owner[:-1]) | (first[1:] != first[:-1] + 1)])
    heads = np.flatnonzero(new)
    count = np.diff(np.concatenate([heads, [len(first)]]))
    who = owner[heads]
    return np.array(rows)[who], key[heads].astype(np.int64), first[heads] - np.array(begins)[who], count


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    at, held, words = 0, [], 0
    for k, text in enumerate(texts):
        raw = (text.as_py() or "").encode()
        held.append(raw)
        words += raw.count(b" ") + 1
        if words > CHUNK_WORDS:
            yield at, held
            at, held, words = k + 1, [], 0
    if held:
        yield at, held


def _windows(own: list | None) -> np.ndarray | None:
    return None if own is None else np.unique(np.concatenate([np.arange(s["first"], s["first"] + s["n"]) for s in own]))


def find_spans(docs: DataFrame, steps: int, window: int = WINDOW, digests: bool = False) -> DataFrame:
    """(name, n, doc_id, text_hash, first) of ``docs`` (doc_id, text_hash, text, and spans that limit the windows, or
    null), with the two halves of each span's digest, p1 and p2, if asked for."""
    names = ["name", "n", "doc_id", "text_hash", "first"] + (["p1", "p2"] if digests else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, asked = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for at, texts in _chunks(batch.column(2)):
                row, name, first, count = spans(texts, [_windows(a.as_py()) for a in asked.slice(at, len(texts))], steps, window)
                columns = [pa.array(x) for x in (name, count.astype(np.int32), ids[row + at], hashes[row + at], first)]
                if digests:
                    parts = [Digests(texts[k]).of(first[row == k], (first + count + window - 1)[row == k]) for k in np.unique(row)]
                    halves = np.concatenate([np.zeros((0, 2), np.int64), *parts])
                    columns += [pa.array(halves[:, 0]), pa.array(halves[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text_hash", "text", "spans").mapInArrow(run, "name long, n int, doc_id long, text_hash long, first long" + (", p1 long, p2 long" if digests else ""))


def _window_digests(rows: DataFrame, window: int) -> DataFrame:
    """(w1, w2, doc_id, text_hash, at) of every window of the spans in ``rows`` (doc_id, text_hash, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                at = _windows(own)
                found = Digests(text.as_py().encode()).of(at, at + window)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.full(len(at), doc)), pa.array(np.full(len(at), key)), pa.array(at)], names=["w1", "w2", "doc_id", "text_hash", "at"])

    return rows.mapInArrow(run, "w1 long, w2 long, doc_id long, text_hash long, at long")


def _shared(found: DataFrame, key: list[str], hot: int) -> DataFrame:
    """``found`` with the least doc_id of each key that several documents have; keys of one document go."""
    several = found.groupBy(*key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("size"))
    return hot_join(found, several.where("least < most").drop("most"), key, "size", hot).drop("size")


def _limited(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``docs`` with the spans that are left of them; the others go."""
    own = kept.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    own = saved(own.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "spans"), "left")
    rows = in_bitmap(docs, saved(bitmap(own, "_d", "_h"), "bits"), "doc_id", "text_hash").where("maybe")
    return rows.join(own.hint("shuffle_hash"), (F.col("doc_id") == F.col("_d")) & (F.col("text_hash") == F.col("_h"))).select("doc_id", "text_hash", "text", "spans")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, first, stop): word ranges that a smaller document has too. ``docs``: (doc_id, text_hash, text)."""
    docs = docs.where("doc_id is not null and text is not null")
    rows = docs.withColumn("spans", F.lit(None).cast("array<struct<first:long,n:int>>"))
    for steps in STEPS:
        last = steps == STEPS[-1]
        found = saved(find_spans(rows, steps, window, last), "spans")
        hot = found.count() // 1000 + 1
        kept = saved(_shared(found, ["name"], hot).drop("least"), "shared")
        discard(found)
        if not last:
            rows = _limited(docs, kept)
    key = ["name", "p1", "p2", "n"]
    least = kept.groupBy(*key).agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    least = saved(least, "least")
    joined = hot_join(kept, least, key, "size", hot).drop("size")
    whole = joined.where("doc_id > least").select("doc_id", "text_hash", "first", (F.col("first") + F.col("n") + F.lit(window - 1)).alias("stop"))
    several = least.groupBy("name").agg(F.min("least").alias("low"), F.max("least").alias("high")).where("low < high").select("name")
    windows = saved(_window_digests(_limited(docs, joined.where("doc_id = least").join(several, "name", "left_semi")), window), "windows")
    single = _shared(windows, ["w1", "w2"], windows.count() // 1000 + 1).where("doc_id > least")
    return whole.unionAll(single.select("doc_id", "text_hash", F.col("at").alias("first"), (F.col("at") + window).alias("stop")))


def drop_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), with the kept text if asked for: one row per row of ``docs``.

    Null texts have no words. Rows without doc_id come before and after nothing: they stay whole and take nothing from
    others. Rows that repeat a doc_id don't take from each other. An empty table gives an empty result."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    ranges = repeats(rows, window).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "stop")).alias("ranges"))
    ranges = saved(ranges.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "ranges"), "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, sums, kept_texts = [], [], [], []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                kept = words
                if own.is_valid:
                    edges = np.zeros(len(words) + 1, np.int64)
                    for r in own.as_py():
                        edges[r["first"]] += 1
                        edges[r["stop"]] -= 1
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                joined = b" ".join(kept)
                total.append(len(words))
                gone.append(len(words) - len(kept))
                sums.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined.decode())
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string()), pa.array(kept_texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns[: 4 + with_text], names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: 4 + with_text])

    joined = rows.join(ranges, (F.col("doc_id") == F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else ""))
