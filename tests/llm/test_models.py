"""Toxicity on held-out rows, embeddings against all pairs, the pipeline against its own rules, and the queries' SQL."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pointloom.llm import embedding_dedup, toxicity
from pointloom.llm.common import components
from pointloom.llm.embedding_dedup import embedding_groups
from pointloom.llm.toxicity import score

SMALL = "/root/testdata/sf0.001"


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 6)))
    rows, labels = [], []
    for k in range(900):
        toxic = k % 4 == 0
        words = [word() for _ in range(int(rng.integers(20, 80)))]
        if toxic:
            for at in rng.integers(0, len(words), 2):
                words[at] = "vexo" + word()  # a known stem, an unseen ending
        rows.append((k, " ".join(words), 1))
        labels.append((k, int(toxic)))
    rows += [(2000, None, 1), (2001, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, _ in labels if got[i].held_out]
    right = [got[i].predicted == int(i % 4 == 0) for i in held]
    assert len(held) > 100 and np.mean(right) > 0.95
    assert got[2000].score == got[2001].score and got[2000].predicted == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(0 <= r.score < 0.01 and r.predicted == 0 for r in score(docs.limit(3), none).collect())


def naive_kneser_ney(words, order=toxicity.ORDER, d=toxicity.DISCOUNT):
    """log p(word | toxic) - log p(word | ordinary) by the textbook, in dictionaries. ``words``: (word, toxic) pairs."""
    grams = lambda w: [x[k - order + 1 : k + 1] for x in [b"\1" * (order - 1) + w + b"\2"] for k in range(order - 1, len(x))]
    top = [Counter(g for w, toxic in words if toxic == c for g in grams(w)) for c in (0, 1)]
    followers = {order: set(top[0]) | set(top[1])}
    for n in range(order - 1, 0, -1):
        followers[n] = {g[1:] for g in followers[n + 1]}
    before = {n: Counter(g[1:] for g in followers[n + 1]) for n in range(1, order)}

    def shared(gram):
        n = len(gram)
        if n == 0:
            return 1 / 256
        total = sum(v for g, v in before[n].items() if g[:-1] == gram[:-1])
        kinds = sum(g[:-1] == gram[:-1] for g in before[n])
        return max(before[n][gram] - d, 0) / total + d * kinds / total * shared(gram[1:]) if total else shared(gram[1:])

    def own(gram, c):
        total = sum(v for g, v in top[c].items() if g[:-1] == gram[:-1])
        kinds = sum(g[:-1] == gram[:-1] for g in top[c])
        return max(top[c][gram] - d, 0) / total + d * kinds / total * shared(gram[1:]) if total else shared(gram[1:])

    return lambda word: sum(np.log(own(g, 1) / own(g, 0)) for g in grams(word))


def test_models_are_kneser_ney(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcé"), rng.integers(1, 9)))
    rows = [(k, int(k % 3 == 0), " ".join(word() for _ in range(12))) for k in range(30)]
    table = toxicity.count(spark.createDataFrame(rows, "doc_id long, toxic int, text string")).toArrow()
    models = toxicity.Models(*[table.column(k).to_numpy() for k in range(3)])
    naive = naive_kneser_ney([(w.encode(), toxic) for _, toxic, text in rows for w in text.split()])
    asked = [word() for _ in range(60)] + ["zzz", "a", "abcabc"]
    assert models.evidence([w.encode() for w in asked]) == pytest.approx([naive(w.encode()) for w in asked])


def test_toxicity_tells_the_drivers_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = score(docs, labels).join(labels, "doc_id").where("held_out").select("score", "toxic").toPandas()
    rank = got.score.rank()
    ones = got.toxic.sum()
    auc = (rank[got.toxic == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(got) - ones))
    assert len(got) > 50 and auc > 0.8


def brute(vectors, cosine=0.9):
    ok = {i: np.array(v, float) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    root, links = {i: i for i, _ in vectors}, {i: 0 for i, _ in vectors}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, u in ok.items():
        for b, v in ok.items():
            if a < b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i in root}


@pytest.mark.parametrize("leaf", [400, 20])
def test_embedding_groups(spark, monkeypatch, leaf):
    monkeypatch.setattr(embedding_dedup, "LEAF", leaf)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 30)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16))
    vectors = [(k, (centres[k % 30] + 0.25 * rng.standard_normal(16)).astype(np.float32).tolist()) for k in range(240)]
    vectors += [(500 + k, vectors[0][1]) for k in range(4)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] + [1.0] * 15), (603, [None] + [1.0] * 15), (604, []), (605, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, id long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_groups(df).collect()}
    want = brute(vectors)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in want)
    if leaf == 400:
        assert got == want
    assert embedding_groups(df.where("false")).count() == 0


def test_embeddings_of_any_size_link_by_their_cosine(spark):
    rows = [(1, [1e-200, 1e-200]), (2, [1.0, 0.001]), (3, [0.001, 1.0]), (4, [1e200, 1e200]), (5, [1.0, 1.0]), (6, [5e-324, 0.0]), (7, [2e300, 1e297])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 4: (2, 1), 5: (2, 1), 2: (2, 2), 6: (2, 2), 7: (2, 2), 3: (0, 3)}


@pytest.mark.parametrize(("shift", "depth", "most"), [(0.0, 10, 25), (0.7, 10, 35), (0.7, 13, 70)])
def test_deep_trees_bring_pairs_together_with_few_copies(shift, depth, most):
    """Pairs of cosine exactly 0.9 among vectors with a common mean: recall, and how often a vector is copied."""
    rng = np.random.default_rng(1)
    mean = np.zeros(64)
    mean[0] = shift
    x = embedding_dedup.unit_rows(mean + rng.standard_normal((45_000, 64)) / 8)
    forest = embedding_dedup.Forest(x[5000:], depth)
    own = x[:2000]
    away = rng.standard_normal(own.shape)
    away -= (away * own).sum(axis=1, keepdims=True) * own
    other = 0.9 * own + math.sqrt(0.19) * away / np.linalg.norm(away, axis=1, keepdims=True)
    met, copies = np.zeros(len(own), bool), 0
    for (_, a, i), (_, b, j) in zip(forest.leaves(own), forest.leaves(other), strict=True):
        met[np.unique(np.intersect1d(a * 2000 + i, b * 2000 + j) % 2000)] = True
        copies += len(i)
        assert np.bincount(np.unique(a, return_inverse=True)[1]).max() < 2000 * 8 / 2 ** min(depth, 8)  # leaves stay even
    assert met.mean() >= 0.985 and copies / len(own) < most


def test_pairs_count_once_and_links_span(spark, monkeypatch):
    """Many vectors all near each other: the links that go on are a forest, and the counts are whole."""
    monkeypatch.setattr(embedding_dedup, "LEAF", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 25)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(12)
    rows = [(k, (base + 0.01 * rng.standard_normal(12)).tolist(), 2) for k in range(160)] + [(900 + k, rng.standard_normal(12).tolist(), 1) for k in range(40)]
    classes = spark.createDataFrame([(i, v, c) for i, v, c in rows], "id long, embedding array<double>, copies long")
    counts, links = embedding_dedup.similar_classes(classes, 12, 200)
    total = {r.id: r.n for r in counts.groupBy("id").agg({"others": "sum"}).withColumnRenamed("sum(others)", "n").collect()}
    assert all(total[k] <= 2 * 159 for k in range(160)) and sum(total[k] for k in range(160)) >= 0.99 * 160 * 2 * 159
    assert links.count() < 160 * 60  # of 12 720 pairs in each of several trees
    named = {r.node: r.component for r in components(links).collect()}
    assert {named[k] for k in range(160)} == {0}


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 90, 90: 90, 95: 90}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SMALL)
        now = spark.createDataFrame(now.toPandas(), now.schema)
        steps.append((name, now))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic, exact, near, mixed, packed = (s.toPandas() for _, s in steps)
    assert set(toxic.doc_id) <= set(texts) and len(toxic) < len(texts)
    groups = {}
    for i in toxic.doc_id:
        groups[texts[i]] = max(i, groups.get(texts[i], i))
    assert set(exact.doc_id) == set(groups.values())
    assert set(near.doc_id) <= set(exact.doc_id)
    assert set(mixed.doc_id) <= set(near.doc_id) and mixed.groupby("doc_id").size().max() <= 2
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    assert set(packed.doc_id) == set(mixed.doc_id)


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns; then nothing at all."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, `_d` string, `copy` int"
    long_text = " ".join(f"w{k % 977}x{k % 131}" for k in range(30_000))
    rows = [(1, None, None, None, None, None, None), (2, "", "en", "a", 0, "x", 1), (3, "one two three four five six", "en", "a", 27, "x", 1), (3, "one two three four five six", "en", "a", 27, "x", 1), (4, "one two three four five six", "en", "b", 27, None, 2)]
    rows += [(None, "no id here", "en", "b", 10, "y", 3), (5, long_text, "en", "b", len(long_text), "z", 4), (6, long_text + " more", "en", "b", len(long_text) + 5, "z", 4), (7, "w" * 100_000, "en", None, 100_000, "z", 5)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            docs.write.mode("overwrite").parquet(f"{tmp_path}/{name}{len(table)}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{len(table)}")
            if name == "exact dedup" and table:
                assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 2, 4, 5, 6, 7]  # null and empty texts are equal
            if name == "minhash near-dedup":
                assert docs.columns == [c.strip("`").split()[0].strip("`") for c in schema.split(", ")]
                assert not table or sorted((r.doc_id or 0) for r in docs.collect()) == [0, 2, 4, 5, 7]
        assert (docs.count() > 0) == bool(table)


def brute_mix(rows):
    """How often the mix takes each (doc_id, text, source): caps one by one, then all copies in one order, cut at the budget."""
    sizes = [(s, hashlib.md5(f"mix:{i}".encode()).hexdigest(), i, len((t or "").encode().split())) for i, t, s in rows]
    sources = sorted({s for s, *_ in sizes}, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sources)}
    whole = {s: sum(x[3] for x in sizes if x[0] == s) for s in sources}
    budget, target, free = 1.5 * sum(whole.values()), {}, set(sources)
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if 2 * whole[s] < level * weight[s]}
        target |= {s: 2.0 * whole[s] if full else level * weight[s] for s in full or free}
        free -= full or free
    copies = []
    for k, s in enumerate(sources):
        done = 0
        for _, h, i, n in sorted(x for x in sizes if x[0] == s):
            done += n
            copies += [((done + again * whole[s]) / target[s], k, again, h, i, n) for again in (0, 1) if target[s]]
    taken, reached = Counter(), 0
    for *_, i, n in sorted(copies):
        reached += n
        if reached > budget:
            break
        taken[i] += 1
    return taken


def test_pipeline_stages_against_brute_force(spark):
    """Near-dedup, mixing and packing, each from the stage's own input."""
    import corpus_pipeline
    from test_text_ops import brute_components, tokenizer, words5

    stages = dict(corpus_pipeline.STAGES)

    def put(name, df):
        df = stages[name](spark, df, SMALL)
        return spark.createDataFrame(df.toPandas(), df.schema)

    exact = put("exact dedup", spark.read.parquet(f"{SMALL}/documents.parquet"))
    near = put("minhash near-dedup", exact)
    mixed = put("mixing sources", near)
    root = brute_components({r.doc_id: words5(r.text) for r in exact.collect()})
    kept = {i for i, c in root.items() if i == c}
    assert sorted(r.doc_id for r in near.collect()) == sorted(kept) and len(kept) < len(root)
    assert Counter(r.doc_id for r in mixed.collect()) == brute_mix([(r.doc_id, r.text, r.source) for r in near.collect()])
    want, t = [], tokenizer("byte_bpe_50k.json")
    for r in mixed.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[s : first if k == 0 else s + 1024]
            want.append((r.doc_id, k, s, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    got = put("best-fit packing", mixed).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024


def test_queries_are_complete():
    from pointloom.llm.queries import ORACLE_SQL, QUERIES

    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
