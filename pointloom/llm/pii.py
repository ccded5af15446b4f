"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

Base spans come from fixed patterns with checks and always stay. Generators propose further, overlapping spans
(obfuscated mail addresses, cards and phones in other groupings or run together with other numbers, addresses with
other separators). Boosted trees score each from its format and the words around it. They are grown on sentences with
known answers: up to half of them stand in contexts of the corpus itself, a bounded sample of places where base spans and
ordinary words stand, half in made-up ones with cue words. An isotonic fit on sentences that the trees have not seen
turns scores into probabilities, and a proposal is selected where its kind's probability reaches ACCEPT."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import drawn, saved

KINDS = ("email", "ip", "card", "phone")
#: Sentences that the trees are grown on, trees, levels of a tree, step, bins of a feature.
SENTENCES, TREES, LEVELS, STEP, BINS = 6000, 60, 3, 0.3, 24
#: Contexts of the corpus that the sentences use (the classifier's documented bound), and the probability that selects.
CONTEXTS, ACCEPT = 2000, 0.9
#: Characters of context on either side.
CONTEXT = 40

#: The base patterns. The address and card patterns are read as whole chains of numbers, each once;
#: LOCAL holds the characters of a mail address before its at sign.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What the generators look for, beyond the base: an at sign in brackets, spelt with a spelt dot, or spaced; numbers in any grouping.
AT = re.compile(r"\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s(?:at|AT)\s(?=[A-Za-z0-9-]+\s(?:dot|DOT)\s)|\s@\s")
AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?[A-Za-z]{2,}|\s(?:dot|DOT)\s[A-Za-z]{2,}|\.[A-Za-z]{2,})+")
NUMBERS = (
    (1, re.compile(r"(?<![\w.:])[0-9]{1,3}(?:\s?[.\[\](),-]{1,3}\s?[0-9]{1,3}){3}(?![\w:]|\.[0-9])")),
    (2, re.compile(r"(?<!\w)[0-9](?:[\x20.\-/]{0,2}[0-9]){12,18}(?!\w)")),
    (2, re.compile(r"(?<![0-9])[0-9]{14,19}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}([\x20.\-/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")),
    (3, re.compile(r"(?<!\w)\(?(?:00|\+)?[0-9(][0-9\x20().\-/]{6,22}[0-9](?!\w)")),
)
DIGIT = re.compile(r"[0-9]")
#: Words that speak for and against a kind; 0 to 3 for the kinds, then what numbers are more often.
WORDS = (
    r"mail|contact|write|reach", r"\bip\b|host|server|address|ping|gateway", r"card|visa|credit|amex|master|payment",
    r"phone|tel\b|call|mobile|fax|dial|whatsapp", r"order|invoice|ref\b|version|page|isbn|sku|total|price|year|date|hash|token|password|serial|section|id\b|no\b",
)
_WORDS = tuple(re.compile(w, re.I) for w in WORDS)
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    """At most 255, however many zeros lead."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done, 0
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[Span]:
    """Four numbers with dots between, taken four by four from each chain, as the leftmost match takes them."""
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(map(_octet, four)):
                yield at, at + size, 1
            at += size + 1


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns: leftmost, not overlapping within a kind, failing matches dropped.

    Every character is read a bounded number of times, so a text of one long number takes no longer than any other."""
    out = list(_emails(text))
    if not DIGIT.search(text):
        return out
    out += _addresses(text)
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in PHONE.finditer(text):
        if 10 <= len(DIGIT.findall(m[0])) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


class Taken:
    """Places that are taken: disjoint ranges in order, asked and extended by bisection."""

    def __init__(self, spans: list[Span] = ()) -> None:
        self.ranges: list[tuple[int, int]] = []
        for s, e, _ in sorted(spans):
            if self.ranges and s <= self.ranges[-1][1]:
                self.ranges[-1] = self.ranges[-1][0], max(e, self.ranges[-1][1])
            else:
                self.ranges.append((s, e))

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.ranges, (end,))
        return k > 0 and self.ranges[k - 1][1] > start

    def add(self, start: int, end: int) -> None:
        insort(self.ranges, (start, end))


def features(text: str, start: int, end: int, kind: int) -> list[float]:
    """Format of the span and context around it."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    parts = re.findall(r"[0-9]+", span)
    number, groups = "".join(parts), [len(g) for g in parts] or [0]
    row = [kind, len(span), len(number), len(groups), max(groups), min(groups), groups[0], groups[-1]]
    row += [span.count(c) for c in " -./(@"] + [span[:1] == "+", span[:2] == "00", span[:1] == "("]
    row += [bool(number) and len(number) < 20 and luhn(number), number[:1] in ("3", "4", "5", "6"), len(set(number)), len(parts) == 4 and all(map(_octet, parts))]
    row += [bool(re.search(r"[\[({<\s](?:at|AT)[\])}>\s]", span)), bool(re.search(r"[\[({<\s](?:dot|DOT)[\])}>\s]", span)), bool(re.search(r"[\[({<](?:at|AT|dot|DOT|\.)[\])}>]", span))]
    row += [before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in "=#$€/\\_:", after[:1] in "%/\\_=:", bool(re.match(r"(19|20)[0-9]{2}\b", span))]
    row += [before[-2:-1].isdigit(), after[1:2].isdigit()]
    row += [bool(w.search(before)) for w in _WORDS] + [bool(w.search(after)) for w in _WORDS[:4]]
    return [float(x) for x in row]


def proposals(text: str, base: list[Span]) -> list[Span]:
    """What the generators find that no base span touches; they may overlap each other."""
    found: set[Span] = set()
    if any(mark in text for mark in ("@", "(", "[", "{", "<", "dot", "DOT")):
        for m in AT.finditer(text):
            start = m.start()
            while start > 0 and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start() and (rest := AFTER_AT.match(text, m.end())):
                found.add((start, rest.end(), 0))
    if DIGIT.search(text):
        for kind, pattern in NUMBERS:
            found.update((m.start(), m.end(), kind) for m in pattern.finditer(text))
    taken = Taken(base)
    return sorted(f for f in found if not taken.meets(f[0], f[1]))


def contexts(docs: DataFrame, most: int = CONTEXTS) -> list[tuple[int, str, str]]:
    """(kind, before, after) of up to ``most`` places in the corpus, drawn by a hash: half base spans, half one word of
    each text (kind -1). All texts are read; what reaches any task or the driver is bounded by ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py() or ""
                if text:
                    word = text.rfind(" ", 0, 1 + xxhash.xxh3_64_intdigest(f"{doc}") % len(text)) + 1
                    for s, e, k in [*base_spans(text), (word, word, -1)]:
                        rows.append((doc, s, k, text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["doc", "at", "kind", "before", "after"])

    places = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc long, at long, kind int, before string, after string")
    places = saved(places, "places")
    halves = [drawn(places.where(test), most // 2, *places.columns) for test in ("kind >= 0", "kind < 0")]
    return sorted(tuple(r) for r in halves[0].unionAll(halves[1]).select("kind", "before", "after").collect())


def _rendered(rng: np.random.Generator, kind: int, yes: bool) -> tuple[str, int, int, bool]:
    """(text, start, end, yes): personal data of the kind, written so that no base pattern finds it, or what looks like it."""
    digit = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(pick(*"bcdfglmnprst") + pick(*"aeiou") for _ in range(rng.integers(1, 4)))
    before = after = ""
    if kind == 0:
        user, host, end = word() + pick("", ".", "_", "-") + pick(word(), digit(2)), word(), pick("com", "org", "net", "de", "fr", "io", "co.uk")
        at, dot = pick((" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "."), ("[at]", "[dot]"), (" AT ", " DOT "), (" @ ", "."), (" at ", " dot "), ("{at}", "."), (" (@) ", "."))
        end = end.replace(".", dot if dot != "." else ".")
        span = user + at + host + dot + end if yes else pick(word() + " @ " + word() + ". " + word(), word() + " (at) " + word() + " " + word(), word() + " at " + word() + " dot by dot", word() + " @ " + word() + " " + word(), word() + " (at) " + digit(2) + "." + digit(2))
    elif kind == 1:
        octets = [str(rng.integers(1, 256)) for _ in range(4)]
        span = pick(" . ", "[.]", "(.)").join(octets) if yes else pick("-", ", ", ",", " - ").join(digit(rng.integers(1, 4)) for _ in range(4))
        if not yes and rng.random() < 0.3:  # numbers of a version, or the like of a longer address
            span = pick(" . ", "[.]").join([*octets[:3], str(rng.integers(256, 999))])
    elif kind == 2:
        stem = pick("4", "51", "37", "6011", "55", "34")
        stem += digit(int(pick(12, 14, 15, 15)) - len(stem))
        span = stem + next(c for c in "0123456789" if luhn(stem + c)) if yes else digit(rng.integers(13, 20))
        yes = yes and len(span) >= 14
        step = int(pick(4, 4, 24))
        joint = pick(" ", "-", ".", "/", "  ")
        span = joint.join(span[k : k + step] for k in range(0, len(span), step))
        if rng.random() < 0.4:  # run together with another number, so that the base pattern reads both as one
            other = digit(int(pick(8, 12, 16))) + pick(" ", "-")
            before, after = pick((other, ""), ("", other[-1] + other[:-1]))
    elif yes:
        span = pick("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "0{}/{}{}", "00{} {} {}", "{} {} {}", "(0{}) {} {}").format(digit(3), digit(3), digit(4))
    else:
        span = pick("{}-{}-{}".format(pick("2019", "1987", "2024"), "0" + digit(1), "1" + digit(1)), digit(rng.integers(8, 13)), "{}.{}".format(digit(5), digit(4)), "{} {}".format(digit(4), digit(4)), "{} / {}".format(digit(4), digit(4)), "{}-{}".format(digit(5), digit(5)), "{}:{}:{}".format(digit(4), digit(4), digit(4)))
    return before + span + after, len(before), len(before) + len(span), yes


def _sentence(rng: np.random.Generator, places: list[tuple[int, str, str]]) -> tuple[str, tuple[int, int], Span | None]:
    """A sentence, made up or a place of the corpus, the range of it whose truth is known, and the personal data there, if any."""
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(pick(*"bcdfglmnprst") + pick(*"aeiou") for _ in range(rng.integers(1, 4)))
    kind, yes = int(rng.integers(0, 4)), rng.random() < 0.5
    text, start, end, yes = _rendered(rng, kind, yes)
    if rng.random() < min(0.5, len(places) / 400):  # a small corpus lends fewer, or a few places would rule
        _, before, after = places[rng.integers(len(places))]
        before, after = before if before[-1:] in (" ", "\n", "") else before + " ", after if after[:1] in (" ", ".", ",", "\n", "") else " " + after
    else:
        cue = (pick("mail", "contact", "write to"), pick("ip", "host", "server address"), pick("card", "visa", "credit card"), pick("phone", "tel", "call", "mobile"))[kind]
        against = pick("order", "invoice", "version", "serial", "isbn", "date", "total", "section", word(), word())
        lead = cue if yes and rng.random() < 0.7 else pick(word(), against) if yes else against
        before, after = f"{word()} {word()} {lead}{pick(' ', ': ', ' is ')}", f"{pick('', '.', ',')} {word()} {word()}"
    at = len(before)
    return before + text + after, (at, at + len(text)), (at + start, at + end, kind) if yes else None


class Trees:
    """Boosted regression trees on binned features, by gradients and curvatures of the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        self.trees, margin = [], np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            nodes, splits = np.zeros(len(y), int), []
            for level in range(LEVELS):
                best = np.zeros((2**level, 3))
                for f in range(x.shape[1]):
                    size = BINS + 1
                    gs, hs = (np.bincount(nodes * size + binned[:, f], v, 2**level * size).reshape(-1, size).cumsum(1) for v in (g, h))
                    gain = gs[:, :-1] ** 2 / (hs[:, :-1] + 1) + (gs[:, -1:] - gs[:, :-1]) ** 2 / (hs[:, -1:] - hs[:, :-1] + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                    at, top = gain.argmax(1), gain.max(1)
                    better = top > best[:, 0] + 1e-9
                    best[better] = np.column_stack([top, np.full(len(at), f), at])[better]
                splits.append(best[:, 1:].astype(int))
                nodes = 2 * nodes + (binned[np.arange(len(y)), splits[-1][nodes, 0]] > splits[-1][nodes, 1])
            leaf = STEP * np.bincount(nodes, g, 2**LEVELS) / (np.bincount(nodes, h, 2**LEVELS) + 1)
            self.trees.append((splits, leaf))
            margin += leaf[nodes]

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)])

    def score(self, x: np.ndarray) -> np.ndarray:
        binned, margin = self._binned(x), np.full(len(x), self.start)
        for splits, leaf in self.trees:
            nodes = np.zeros(len(x), int)
            for s in splits:
                nodes = 2 * nodes + (binned[np.arange(len(x)), s[nodes, 0]] > s[nodes, 1])
            margin += leaf[nodes]
        return 1 / (1 + np.exp(-margin))


def _examples(seed: int, n: int, places: list[tuple[int, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    rng, rows, labels = np.random.default_rng(seed), [], []
    for _ in range(n):
        text, known, truth = _sentence(rng, places)
        for s, e, k in proposals(text, base_spans(text)):
            if s >= known[1] or e <= known[0]:
                continue  # what the corpus has around it is of unknown truth
            rows.append(features(text, s, e, k))
            labels.append(truth is not None and k == truth[2] and abs(s - truth[0]) + abs(e - truth[1]) <= 2)
    return np.array(rows), np.array(labels, float)


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least score, probability) of the steps of the best rising fit; each step's share is held to the middle by two rows."""
    least, back = np.unique(scores, return_inverse=True)
    steps: list[list[float]] = []  # least score, right ones, all
    for step in zip(least.tolist(), np.bincount(back, y).tolist(), np.bincount(back).tolist(), strict=True):
        steps.append(list(step))
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, right, n = steps.pop()
            steps[-1][1] += right
            steps[-1][2] += n
    return np.array([s[0] for s in steps]), np.array([(s[1] + 1) / (s[2] + 2) for s in steps])


class Selector:
    """The trees and, for each kind, the least score whose calibrated probability reaches ACCEPT; 2 where none does."""

    def __init__(self, places: list[tuple[int, str, str]]) -> None:
        self.trees = Trees(*_examples(1, SENTENCES, places))
        x, y = _examples(2, SENTENCES // 2, places)
        scores = self.trees.score(x)
        self.thresholds = np.full(len(KINDS), 2.0)
        for kind in range(len(KINDS)):
            own = x[:, 0] == kind
            if own.any():
                least, probability = isotonic(scores[own], y[own])
                good = least[probability >= ACCEPT]
                self.thresholds[kind] = good[0] if len(good) else 2.0

    def measure(self, places: list[tuple[int, str, str]], seed: int = 3, n: int = 3000) -> dict[str, tuple[float, float]]:
        """Precision and recall, by kind, of what is added to sentences that neither trees nor thresholds have seen."""
        rng, right, said, there = np.random.default_rng(seed), np.zeros(len(KINDS)), np.zeros(len(KINDS)), np.zeros(len(KINDS))
        for _ in range(n):
            text, known, truth = _sentence(rng, places)
            base = base_spans(text)
            if truth is None or any(s < truth[1] and truth[0] < e for s, e, _ in base):
                truth = None if truth is None else (-9, -9, truth[2])  # the base has it already
            elif truth:
                there[truth[2]] += 1
            for s, e, k in self.added([text], [base])[0]:
                if s >= known[1] or e <= known[0]:
                    continue
                said[k] += 1
                right[k] += truth is not None and k == truth[2] and abs(s - truth[0]) + abs(e - truth[1]) <= 2
        return {name: (right[k] / max(said[k], 1), right[k] / max(there[k], 1)) for k, name in enumerate(KINDS)}

    def added(self, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
        """The proposals that reach their kind's threshold; of overlapping ones the best, then the first, then the longest."""
        free = [proposals(text, base) for text, base in zip(texts, bases, strict=True)]
        rows = [features(text, *s) for text, own in zip(texts, free, strict=True) for s in own]
        if not rows:
            return [[] for _ in texts]
        scores, at, out = self.trees.score(np.array(rows)), 0, []
        for own in free:
            best, taken = [], Taken()
            for s, score in sorted(zip(own, scores[at : at + len(own)].tolist(), strict=True), key=lambda c: (-c[1], c[0][0], -c[0][1], c[0][2])):
                if score >= self.thresholds[s[2]] and not taken.meets(s[0], s[1]):
                    taken.add(s[0], s[1])
                    best.append(s)
            at += len(own)
            out.append(best)
        return out


@cache
def made_up() -> Selector:
    """A selector grown without a corpus."""
    return Selector([])


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of ``docs``.

    Counts and base_sha256 are of the base spans, spans has all; places count code points, ends are exclusive. Null
    and empty texts have none. An empty table gives an empty result; repeated rows are rows of their own; ties between
    proposals go to the first, then the longest. Extra columns are left out."""
    selector = Selector(contexts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            bases = [base_spans(t) for t in texts]
            more = selector.added(texts, bases)
            counts = [[sum(s[2] == k for s in base) for base in bases] for k in range(len(KINDS))]
            sums = [hashlib.sha256(_listed(base).encode()).hexdigest() if base else none for base in bases]
            listed = [_listed(base + own) for base, own in zip(bases, more, strict=True)]
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(sums, pa.string()), pa.array(listed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, selector: Selector | None = None) -> str:
    """The text with a mark in place of each span."""
    base = base_spans(text)
    spans, at, out = sorted(base + (selector or made_up()).added([text], [base])[0]), 0, []
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
