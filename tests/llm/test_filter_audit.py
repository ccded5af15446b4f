"""The filter audit against brute force, with nulls, ties, repeated rows and clashing columns."""

import re
from collections import defaultdict
from itertools import permutations

from pointloom.llm.filter_audit import audit, interactions

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    out = []
    for doc, text, _ in rows:
        t = text or ""
        words = WORD.findall(t)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        bad["E"] = doc is not None and any(d is not None and d < doc and (o or "") == t for d, o, _ in rows)
        out.append({k for k, v in bad.items() if v})
    return out


def brute(rows, labels):
    good, toxic = ({d for d, *marks in labels if marks[k] == 1 and d is not None} for k in (0, 1))
    parts, shares = defaultdict(list), defaultdict(int)
    for (doc, _, source), bad in zip(rows, fails(rows), strict=True):
        parts[source or ""].append((doc, bad))
    out = {}
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                left = [(d, bad) for d, bad in docs if not bad & set(order[: step - 1])]
                gone = [d for d, bad in left if letter in bad]
                shares[part, letter] += len(gone)
                out[part, order, step] = [len(left) - len(gone), len(gone), sum(letter in bad for _, bad in docs) - len(gone), sum(bad == {letter} for _, bad in docs), sum(d in good for d in gone), sum(d in toxic for d in gone)]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark):
    long = " ".join(f"w{k}" for k in range(220))
    rows = [
        (1, long, "a"), (2, long, "a"), (3, long + " #", "a"), (4, None, "b"), (5, "", "b"), (6, "SHOUT " * 300, "b"), (7, long.upper(), None), (8, "é" * 99 + "A", ""), (9, "é" * 99 + "AAA", "a"),
        (10, "x " * 250 + "y|", "a"), (None, long, "a"), (None, None, "c"), (11, long, "c"), (11, long, "c"), (12, "w " * 20_000, "b"), (1, long, "b"), (13, " one\x1ctwo three", "a"), (14, long + "\x85z", None),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (6, 0, 1), (11, 1, None), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(d, t, s, 5, "m") for d, t, s in rows], "doc_id long, text string, source string, step int, part string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute(rows, labels)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    for table in (docs, docs.repartition(7)):
        got = audit(table, marks).collect()
        assert len(got) == len(want) == 600 * 4 and {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got} == want
    assert audit(docs.where("false"), marks).count() == 0
    assert audit(docs.where("doc_id = 1"), marks.where("false")).count() == 1200


def test_any_number_of_filters(spark):
    cells = spark.createDataFrame([("p", 3, 10, 1, 2), ("p", 1, 4, 0, 0), ("p", 0, 6, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in interactions(cells, "XY").collect()}
    assert got == {("XY", 1): (6, 14, 0, 4, 18), ("XY", 2): (6, 0, 10, 0, 10), ("YX", 1): (10, 10, 0, 0, 10), ("YX", 2): (6, 4, 10, 4, 18)}
