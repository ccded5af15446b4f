"""Language identification by spans.

A word is a run of letters. The scripts of its letters, read off ranges of code points, narrow the languages that it can
be in; runs of one to four letters, counted by language over labelled documents, score it in each. A Viterbi path over
the words of a document, which pays SWITCH for each change of language, labels spans, so a text of several languages
falls into its parts; the document's language is the one with the most letters.

All of this is array work over many documents at once. Most documents are of one language, and for these the path is
known without walking it: where no stretch of words gains more than SWITCH in any other language, no change can pay."""

from __future__ import annotations

import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About how many labelled rows a language gives to the counts, chosen by a hash, and how many languages are learned at
#: most, the most frequent first: the classifier's documented bounds. With up to FIT_ROWS rows all are taken.
FIT_ROWS, MOST_LANGS = 8_000, 64
#: Letters of a run, places of the table of one length of runs, what a language borrows from all (in runs).
ORDERS, BUCKETS, BORROWED = (1, 2, 3, 4), 1 << 15, 50.0
#: What a change of language costs, the most that one word can speak against a language, what a script it doesn't use does.
SWITCH, MOST, NARROWED = 8.0, 6.0, 20.0
#: The share of a language's letters from which a script counts as one it uses.
USED = 0.01
#: Numbers that one slice of scores holds, code points that are looked at together.
NUMBERS, TOGETHER = 1 << 22, 1 << 20

#: Ranges of code points by script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "ethiopic": [(0x1200, 0x139F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(zlib.crc32(b"") % 3 == 1))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 1 for a letter, 2 for a mark, else 0; its lower case; its script (0 none, then by SCRIPTS)."""
    kind, low, script = np.zeros(sys.maxunicode + 1, np.uint8), np.arange(sys.maxunicode + 1, dtype=np.uint32), np.zeros(sys.maxunicode + 1, np.uint8)
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        group = unicodedata.category(c)[0]
        if group == "L":
            kind[k] = 1
            if len(small := c.lower()) == 1:
                low[k] = ord(small)
        elif group == "M":
            kind[k] = 2
    for n, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = n
    return kind, low, script


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, a gap of one before each and at the end, and where each text begins."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    begins = np.cumsum([1, *[len(p) + 1 for p in parts]])
    out = np.zeros(begins[-1], np.uint32)
    for p, at in zip(parts, begins, strict=False):
        out[at : at + len(p)] = p
    return out, begins[:-1]


def _words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of letters (marks with them) begin and end; a gap stands on either side of each."""
    inside = np.concatenate([[0], (_tables()[0][points] > 0).view(np.int8), [0]])
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def _grams(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, bucket) for each length of ORDERS: runs of letters that end at a place, the gap before or behind a word
    counting as a letter. ``points`` begins with a gap."""
    kind, low, _ = _tables()
    inside = kind[points] > 0
    letters = np.where(inside, low[points], 0).astype(np.uint64)
    at = np.arange(len(points), dtype=np.int64)
    depth = at - np.maximum.accumulate(np.where(inside, -1, at))
    behind = np.zeros(len(points), np.int64)  # letters of the word that ends just before
    behind[1:] = np.where(inside[1:], 0, depth[:-1])
    h = letters
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            h = np.concatenate([np.zeros(1, np.uint64), h[:-1] * np.uint64(1_000_003)]) + letters
        if n in ORDERS:
            good = inside if n == 1 else (inside & (depth >= n - 1)) | (behind >= max(1, n - 2))
            place = np.flatnonzero(good)
            yield place, ((h[place] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def viterbi(scores: np.ndarray, starts: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word (a row of ``scores``) on the best path of its document; documents are runs of rows
    that begin at ``starts``, none of them empty."""
    n, langs = scores.shape
    path = np.zeros(n, np.uint8)
    if not n or langs == 1:
        return path
    lengths = np.diff(np.append(starts, n))
    doc = np.repeat(np.arange(len(starts)), lengths)
    best = (np.add.reduceat(scores, starts, axis=0, dtype=np.float64) + prior).argmax(axis=1)
    own = scores[np.arange(n), best[doc]].astype(np.float64)
    apart = (MOST + NARROWED) * 2.0 * (lengths.max() + 1)
    most = np.zeros(len(starts))
    for k in range(langs):  # the most that a stretch gains in language k: a running total less its least value before
        gain = scores[:, k] - own
        total = np.cumsum(gain) - apart * doc
        stretch = total - np.minimum.accumulate(total - gain)
        most = np.maximum(most, np.maximum.reduceat(stretch, starts) + np.maximum(0.0, prior[k] - prior[best]))
    path[:] = best[doc]
    open_ = np.flatnonzero(most > switch - 1e-6)
    open_ = open_[np.argsort(-lengths[open_], kind="stable")]
    if len(open_):
        first, size = starts[open_], lengths[open_]
        live = np.searchsorted(-size, -np.arange(size[0]), side="left")  # documents that are longer than t
        value = scores[first] + prior
        came, stayed = np.zeros(n, np.uint8), np.zeros((n, langs), bool)
        for t in range(1, size[0]):
            rows, v = first[: live[t]] + t, value[: live[t]]
            came[rows] = v.argmax(axis=1)
            jump = v.max(axis=1, keepdims=True) - switch
            stayed[rows] = v >= jump
            value[: live[t]] = np.maximum(v, jump) + scores[rows]
        state = value.argmax(axis=1)
        for t in range(size[0] - 1, -1, -1):
            rows, s = first[: live[t]] + t, state[: live[t]]
            path[rows] = s
            if t:
                state[: live[t]] = np.where(stayed[rows, s], s, came[rows])
    return path


class Model:
    """What a run of letters and a script say for each language; at most MOST_LANGS by BUCKETS numbers a length of runs."""

    def __init__(self, langs: list[str], rows: list[int], grams: np.ndarray, scripts: np.ndarray) -> None:
        """``grams``: counts by (length, language, bucket); ``scripts``: letters by (language, script)."""
        self.langs = langs
        share = grams / np.maximum(grams.sum(axis=2, keepdims=True), 1)
        pooled = share.sum(axis=1, keepdims=True) / max(1, len(langs)) + 1e-3 / BUCKETS
        smooth = np.log((grams + BORROWED * pooled) / (grams.sum(axis=2, keepdims=True) + BORROWED))
        self.table = np.ascontiguousarray(smooth.transpose(0, 2, 1)).astype(np.float32) / len(ORDERS)
        uses = scripts >= USED * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.uses = np.array([sum(int(u) << k for k, u in enumerate(column)) for column in uses.T], np.uint64)
        self.uses[0] = np.uint64((1 << len(langs)) - 1)  # marks and letters of no listed script narrow nothing
        total = np.array(rows, float)
        self.prior = np.maximum(np.log(np.maximum(total, 1) / max(1.0, total.sum())), -5.0)

    def words(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A row of scores for each word: 0 in the likeliest language, less in others. Words alike are scored once."""
        if not len(begin):
            return np.zeros((0, len(self.langs)), np.float32)
        size = end - begin
        heads = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(heads, size)  # place within the word
        letters = _tables()[1][points[np.repeat(begin, size) + at]].astype(np.uint64) + np.uint64(1)
        powers = np.cumprod(np.full(size.max(), 0xD1342543DE82EF95, np.uint64))
        named = np.add.reduceat((letters ^ letters << np.uint64(29)) * powers[at], heads)
        _, first, which = np.unique(named, return_index=True, return_inverse=True)
        begin, size = begin[first], size[first]
        tail = np.cumsum(size + 1)
        place = np.repeat(begin - (tail - size), size) + np.delete(np.arange(tail[-1] + 1), np.append(0, tail))
        packed = np.zeros(tail[-1] + 1, np.uint32)  # each word once, a gap before and behind
        packed[np.delete(np.arange(tail[-1] + 1), np.append(0, tail))] = points[place]
        return self._each(packed, tail - size, tail)[which]

    def _each(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, _, script = _tables()
        out = np.zeros((len(begin), len(self.langs)), np.float32)
        bits, most = np.arange(len(self.langs), dtype=np.uint64), max(1, NUMBERS // len(self.langs))
        at = 0
        while at < len(begin):
            to = max(at + 1, int(np.searchsorted(end, begin[at] + most)))
            low = begin[at] - 1
            part = points[low : end[to - 1] + 1]
            each = np.zeros((len(part), len(self.langs)), np.float32)
            for table, (place, bucket) in zip(self.table, _grams(part), strict=True):
                each[place] += table[bucket]
            heads = begin[at:to] - low
            rows = np.add.reduceat(each, heads, axis=0)
            masks = self.uses[script[part]]
            masks[_tables()[0][part] != 1] = self.uses[0]
            may = np.bitwise_and.reduceat(masks, heads)
            may[may == 0] = self.uses[0]
            may = (may[:, None] >> bits & np.uint64(1)).astype(bool)
            top = np.where(may, rows, -np.inf).max(axis=1, keepdims=True)
            out[at:to] = np.where(may, np.maximum(rows - top, -MOST), -NARROWED)
            at = to
        return out

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, pa.Array]:
        """(language, score, spans) of whole texts; texts of like length are looked at together."""
        order = sorted(range(len(texts)), key=lambda k: len(texts[k] or ""))
        langs, scores, spans = ["und"] * len(texts), np.zeros(len(texts)), [[]] * len(texts)
        at = 0
        while at < len(order):
            to, size = at, 0
            while to < len(order) and (to == at or size + len(texts[order[to]] or "") <= TOGETHER):
                size += len(texts[order[to]] or "") + 1
                to += 1
            for k, (lang, score, found) in zip(order[at:to], self._together([texts[k] or "" for k in order[at:to]]), strict=True):
                langs[k], scores[k], spans[k] = lang, score, found
            at = to
        return langs, scores, pa.array(spans, SPANS)

    def _together(self, texts: list[str]) -> Iterator[tuple[str, float, list[dict]]]:
        points, begins = _points(texts)
        begin, end = _words(points)
        letters = np.concatenate([[0], np.cumsum(_tables()[0][points] == 1)])
        weight = letters[end] - letters[begin]
        begin, end, weight = begin[weight > 0], end[weight > 0], weight[weight > 0]
        doc = np.searchsorted(begins, begin, side="right") - 1
        n, k = len(texts), len(self.langs)
        if not k or not len(begin):
            yield from (("und", 0.0, []) for _ in texts)
            return
        scores = self.words(points, begin, end)
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        path = viterbi(scores, starts, self.prior)
        by = np.bincount(doc * k + path, weight, n * k).reshape(n, k)
        best = by.argmax(axis=1)
        mine = path == best[doc]
        evidence = np.stack([np.bincount(doc[mine], scores[mine, j], n) for j in range(k)], axis=1) + self.prior
        evidence -= evidence[np.arange(n), best][:, None]
        sure = 1 / np.exp(np.minimum(evidence, 700)).sum(axis=1) * by.max(axis=1) / np.maximum(by.sum(axis=1), 1)
        turn = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(path.astype(np.int64), prepend=-1) != 0))
        last = np.append(turn[1:], len(doc)) - 1
        found: list[list[dict]] = [[] for _ in texts]
        for d, a, b, lang in zip(doc[turn].tolist(), begin[turn].tolist(), end[last].tolist(), path[turn].tolist(), strict=True):
            found[d].append({"start": a - int(begins[d]), "end": b - int(begins[d]), "lang": self.langs[lang]})
        for d in range(n):
            yield (self.langs[best[d]], float(np.clip(sure[d], 0, 1)), found[d]) if found[d] else ("und", 0.0, [])


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def _count(langs: list[str]):
    """Arrow batches of (lang, text) to sparse counts (length, lang, bucket, n) of what a task has read; length 0: scripts."""
    index = {lang: k for k, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, _, script = _tables()
        counts = [np.zeros(len(langs) * (len(SCRIPTS) + 1), np.int64), *[np.zeros(len(langs) * BUCKETS, np.int64) for _ in ORDERS]]
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points, k = _points([text])[0], index[lang]
                for at in range(0, len(points), TOGETHER):  # a run across two slices is lost to the counts
                    part = np.concatenate([np.zeros(1, np.uint32), points[at : at + TOGETHER], np.zeros(1, np.uint32)])
                    counts[0] += np.bincount(k * (len(SCRIPTS) + 1) + script[part[kind[part] == 1]].astype(np.int64), minlength=len(counts[0]))
                    for own, (_, bucket) in zip(counts[1:], _grams(part), strict=True):
                        np.add.at(own, k * BUCKETS + bucket, 1)
        for length, own in enumerate(counts):
            full, wide = np.flatnonzero(own), len(own) // max(1, len(langs))
            for at in range(0, len(full), 50_000):
                f = full[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), length, np.int32)), pa.array((f // wide).astype(np.int32)), pa.array((f % wide).astype(np.int32)), pa.array(own[f])], names=["length", "lang", "bucket", "n"])

    return run


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model of the languages of ``docs`` (doc_id, text, lang). Rows of ``held_out``, without lang or without text take no part."""
    known = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id"))).select(F.col("lang").cast("string"), "text", "doc_id")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    sizes = {r.lang: r.n for r in sorted(sizes, key=lambda r: r.lang)}
    langs = list(sizes)
    grams, scripts = np.zeros((len(ORDERS), len(langs), BUCKETS), np.int64), np.zeros((len(langs), len(SCRIPTS) + 1), np.int64)
    if langs:
        chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
        share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, fit_rows / n))) for lang, n in sizes.items()])
        rows = known.where(chance < share).select("lang", "text").mapInArrow(_count(langs), "length int, lang int, bucket int, n long")
        table = rows.groupBy("length", "lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most a number for each place of the tables
        length, lang, bucket, n = (table.column(k).to_numpy() for k in range(4))
        scripts[lang[length == 0], bucket[length == 0]] = n[length == 0]
        grams[length[length > 0] - 1, lang[length > 0], bucket[length > 0]] = n[length > 0]
    return Model(langs, list(sizes.values()), grams, scripts)


def label(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, spans), one row per row of ``docs``; a span is (start, end, lang) in code points.

    ``lang_pred`` is the language with the most letters in its spans, the first by name of those that tie, and ``und``
    for null texts, texts without a letter, and where nothing was learned. ``score`` is the share of the letters in that
    language times how likely it is for them; 0 for ``und``. Rows that repeat an id are documents of their own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_LANGS and BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, spans = shared.value.label(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), spans], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def languages(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans), learned from and applied to ``docs`` (doc_id, text, lang).

    An empty table gives an empty result; extra columns are left out, whatever their names."""
    out = label(docs, learn(docs, fit_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
