"""Toxicity by class-conditional Kneser-Ney models of letters.

Two models of the letters of words (bytes; a word stands behind ORDER - 1 begin marks and before an end mark) are
counted over labelled documents, one over toxic, one over ordinary ones. The counts of whole runs of ORDER letters are
each class's own. Every order below is one shared Kneser-Ney backoff: a shorter run weighs as many different letters as
stand before it in the runs of both classes together, so a rare expression is smoothed alike in both and speaks only as
far as its class has seen it. All runs count, those seen once too. Runs end with their word, so a toxic phrase of
ordinary words has no evidence as a phrase.

A word's evidence is the difference of its two log-likelihoods. A document is judged by length-normalised differences:
over the whole text, over its strongest SPAN words and over its strongest word (a few toxic words in a long text hardly
move the first), with the root-normalised sum and the length itself; a logistic fit on labelled documents that were
not counted maps them to a probability."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import drawn, saved

#: Labelled rows that one class gives to the fit, chosen by a hash of the id. The classifier's documented bound.
FIT_ROWS = 8_000
#: One labelled row in so many calibrates and is not counted.
CALIBRATE = 4
#: Letters of a run, the discount, the score from which a document counts as toxic, words of a window of evidence.
ORDER, DISCOUNT, THRESHOLD, SPAN = 6, 0.75, 0.3, 12
#: Words that one generation of a worker's cache holds; two generations are kept.
CACHE_WORDS = 200_000
#: Texts that are split into words at once, and new words that are counted at once.
TEXTS, WORDS = 256, 40_000
FEATURES = 6
#: Letters, the end mark among them.
LETTERS = 256

_BEGIN, _END = b"\x01" * (ORDER - 1), b"\x02"
_EDGES = b".,;:!?\"'()[]{}*#$%&|-"


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(zlib.crc32(b"") % 4 == 2))


def _words(text: str | None) -> list[bytes]:
    """The words in lower case."""
    return (text or "").lower().encode().split()


def _runs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, run): for each letter and end mark of each word the ORDER letters that end there, as the bytes of one number."""
    marked = [_BEGIN + (w.strip(_EDGES) or w) + _END for w in words]
    flat = np.frombuffer(b"".join(marked), np.uint8).astype(np.int64)
    lengths = np.array([len(m) for m in marked], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    run = flat.copy()
    for k in range(1, ORDER):
        run[k:] |= flat[:-k] << (8 * k)
    inside = place >= ORDER - 1
    return owner[inside], run[inside]


def _last(run: np.ndarray, n: int) -> np.ndarray:
    return run & ((1 << (8 * n)) - 1)


def count(rows: DataFrame) -> DataFrame:
    """(run, toxic, ordinary): how often each run of ORDER letters stands in either class of ``rows`` (toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            owner, runs = _runs(list(seen))
            weights = np.array(list(seen.values()), np.int64)[owner]
            key, back = np.unique(runs, return_inverse=True)
            sums = [np.bincount(back, weights[:, c], len(key)).astype(np.int64) for c in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, sums)], names=["run", "toxic", "ordinary"])
            seen.clear()

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for w, n in Counter(_words(text.as_py())).items():
                    seen.setdefault(w, [0, 0])[toxic] += n
                if len(seen) > WORDS:
                    yield from out()
        if seen:
            yield from out()

    counted = rows.select(F.col("toxic").cast("int"), "text").mapInArrow(run, "run long, toxic long, ordinary long")
    return counted.groupBy("run").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


class _Evidence(dict):
    """Evidence by word; asks the generation before, and marks what is new."""

    def __init__(self, old: dict) -> None:
        self.old, self.new = old, []

    def __missing__(self, word: bytes) -> float:
        found = self.old.get(word)
        if found is None:
            self.new.append(word)
            found = 0.0
        self[word] = found
        return found


class Models:
    """The two models as sorted tables: discounted shares by run, and the mass that each context leaves to the shared backoff."""

    def __init__(self, run: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> None:
        order = np.argsort(run)
        self.run, counts = run[order], np.stack([toxic[order], ordinary[order]], 1).astype(float)
        self.context, back = np.unique(self.run >> 8, return_inverse=True)
        total, kinds = (np.stack([np.bincount(back, v[:, c], len(self.context)) for c in (0, 1)], 1) for v in (counts, counts > 0))
        self.share = np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1)[back]
        self.rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        # Shared by both classes: how many different letters stand before a shorter run, whichever class they are from.
        self.backoff, longer = [], self.run
        for n in range(ORDER - 1, 0, -1):
            shorter, before = np.unique(_last(longer, n), return_counts=True)
            context, back = np.unique(shorter >> 8, return_inverse=True)
            total = np.bincount(back, before, len(context))
            self.backoff.insert(0, (shorter, (before - DISCOUNT) / total[back], context, DISCOUNT * np.bincount(back, minlength=len(context)) / total))
            longer = shorter
        self.fit = np.zeros(FEATURES)
        self.known = _Evidence({})

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(table):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def shared(self, run: np.ndarray) -> np.ndarray:
        """The probability of each run's last letter by the shared backoff, from no letters before it up to ORDER - 2."""
        p = np.full(len(run), 1 / LETTERS)
        for n, (shorter, share, context, rest) in enumerate(self.backoff, 1):
            own, at = self._find(shorter, _last(run, n)), self._find(context, _last(run, n) >> 8)
            if len(shorter):
                p = np.where(at >= 0, np.where(own >= 0, share[own], 0.0) + rest[at] * p, p)
        return p

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """The difference of the two log-likelihoods of each word."""
        owner, run = _runs(words)
        at = self._find(self.context, run >> 8)
        owner, run, at = owner[at >= 0], run[at >= 0], at[at >= 0]  # behind other contexts both have the shared backoff alone
        own = self._find(self.run, run)
        if not len(run):
            return np.zeros(len(words))
        p = np.where((own >= 0)[:, None], self.share[own], 0.0) + self.rest[at] * self.shared(run)[:, None]
        return np.bincount(owner, np.log(p[:, 0] / p[:, 1]), len(words))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: 1, mean evidence, strongest word, strongest window, root-normalised sum, log of the length; no words give zeros."""
        if len(texts) > TEXTS:
            return np.vstack([self.features(texts[at : at + TEXTS]) for at in range(0, len(texts), TEXTS)])
        if len(self.known) > CACHE_WORDS:
            self.known = _Evidence(dict(self.known))
        split = [_words(t) for t in texts]
        for words in split:
            for _ in map(self.known.__getitem__, words):
                pass
        if self.known.new:
            new, self.known.new = self.known.new, []
            for at in range(0, len(new), 50_000):
                part = new[at : at + 50_000]
                self.known.update(zip(part, self.evidence(part).tolist(), strict=True))
        out = np.zeros((len(texts), FEATURES))
        for k, words in enumerate(split):
            out[k, 0] = 1
            if words:
                d = np.fromiter(map(self.known.__getitem__, words), float, len(words))
                sums = np.concatenate([[0.0], np.cumsum(d)])
                span = min(SPAN, len(d))
                out[k, 1:] = d.mean(), d.max() / 5, (sums[span:] - sums[:-span]).max() / 5, d.sum() / math.sqrt(len(d)) / 5, math.log1p(len(d)) / 5
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """A logistic fit by Newton's method, slightly held to zero."""
        w = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-9:
                break
        self.fit = w

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.fit, -30, 30)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": _Evidence({})}


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Models:
    """Models of up to ``fit_rows`` labelled rows of a class. Rows of ``held_out`` take no part.

    A document labelled twice counts as toxic if any label says so; null labels are none."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for label in (0, 1):
        part = drawn(known.where(F.col("toxic") == label), fit_rows, "doc_id")
        chosen = part if chosen is None else chosen.unionAll(part)
    chosen = saved(chosen, "fit")
    # At most twice fit_rows ids: bounded by a parameter, so it is broadcast.
    rows = saved(docs.select("doc_id", "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "_d")), F.col("doc_id") == F.col("_d")).select("doc_id", "toxic", "text"), "labelled")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(CALIBRATE))
    table = count(rows.where(fold != 0)).toArrow()  # runs of at most twice fit_rows texts
    models = Models(*[table.column(k).to_numpy() for k in range(3)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = models.features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

    table = rows.where(fold == 0).select(F.col("toxic").cast("int"), "text").mapInArrow(run, "toxic int, x array<double>").toArrow()
    x = np.array(table.column(1).to_pylist(), np.float64).reshape(-1, FEATURES)
    share = min(max(known.agg(F.avg("toxic")).first()[0] or 0.0, 1e-6), 1 - 1e-6)
    own, y = 0.5, table.column(0).to_numpy().astype(np.float64)
    if len(y):
        models.calibrate(x, y)
        own = min(max(y.mean(), 1e-6), 1 - 1e-6)
    # The bound may take more of one class than of the other; the intercept gets the share of all labels back.
    models.fit[0] += math.log(share / (1 - share)) - math.log(own / (1 - own))
    return models


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    Null and empty texts have no words and get the score of no evidence. Without any labels all
    scores are near 0: nothing is known to be toxic. An empty table gives an empty result; extra columns are left out."""
    models = learn(docs, labels, fit_rows)
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = models.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the documents that score at or above ``threshold``, all columns kept, whatever their names.

    Null and empty texts have no evidence; without labels, nothing goes. Rows alike fare alike. An empty table gives an
    empty result."""
    models = learn(docs, labels, fit_rows)

    @F.pandas_udf("boolean")
    def clean(texts):
        return pd.Series(models.score(texts.tolist()) < threshold)

    return docs.where(clean("text"))
