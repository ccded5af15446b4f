"""The operators over documents against brute force, with nulls, empty and repeated rows, ties and extra columns."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointloom.llm import near_dedup, packing, pii, substring_dedup
from pointloom.llm.chat import format_chats
from pointloom.llm.common import bitmap, drawn, hot_join, in_bitmap
from pointloom.llm.exact_dedup import drop_copies, exact_groups
from pointloom.llm.mixing import mix_digest, mix_documents
from pointloom.llm.near_dedup import drop_near, near_groups
from pointloom.llm.token_store import digest, read_tokens, write_tokens
from pointloom.llm.tokens import Ids
from pointloom.llm.toxicity import drop_toxic

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(1, 5)))
    base = [word() for _ in range(4000)]
    out = [(0, None, "b"), (1, "", "b"), (2, "  \n\t ", None), (3, "one", "a"), (4, "x " * 120, "a"), (5, "x " * 90, "a")]
    for k in range(60):
        at = random.randint(0, 3800)
        out.append((10 + k, " ".join(base[at : at + random.randint(3, 160)]), random.choice(["a", "b", "c", None])))
    out += [(200 + k, out[20 + k % 3][1], "c") for k in range(9)]
    out += [(300, " ".join(base), "long"), (301, "Größe œuvre 日本語 naïve\x1c1 2", "a"), (302, "end <|endoftext|> and<|startoftext|>  on", "a")]
    return out


def test_exact_groups(spark, rows):
    got = exact_groups(docs(spark, rows)).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want and len(got) == len(rows)
    kept = drop_copies(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if w[2]}


def test_exact_groups_keeps_one_of_rows_alike(spark):
    got = exact_groups(docs(spark, [(5, "a", "s"), (5, "a", "s"), (4, "a", "s"), (None, "b", "s")])).collect()
    assert sorted((r.doc_id or 0, r.kept, r.group_size) for r in got) == [(0, True, 1), (4, False, 3), (5, False, 3), (5, True, 3)]
    assert exact_groups(docs(spark, [])).count() == 0 and drop_copies(docs(spark, [])).count() == 0


#: Every name that the stages use inside, and a few that look like one.
CLASHES = ["row", "h", "s", "_h", "_t", "_d", "_s", "_keep", "_one", "_size", "_key", "_source", "_copy", "key", "size", "last0", "copy", "maybe", "_word", "_bits", "best", "none", "doc", "hash", "toxic", "score", "keep_id", "a.b", "n", "component_id"]


@pytest.mark.parametrize("stage", [drop_copies, drop_near, mix_documents, lambda d: drop_toxic(d, d.sparkSession.createDataFrame([(2, 0), (7, 0)], "doc_id long, toxic int"))])
def test_stages_keep_all_columns(spark, stage):
    texts = [(1, None), (2, "a b c d e f g"), (3, "a b c d e f g"), (4, ""), (5, "x" * 300_000), (6, "1 2 3"), (7, "q r s t u v"), (None, "1 2 3"), (None, None), (6, "1 2 3")]
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    rows = spark.createDataFrame([(i, t, "s", *[f"{c}:{i}" for c in CLASHES]) for i, t in texts], f"doc_id long, text string, source string, {extra}")
    got = stage(rows)
    assert got.columns == rows.columns
    found = got.collect()
    assert found and all(r[k + 3] == f"{c}:{r.doc_id}" for r in found for k, c in enumerate(CLASHES))
    assert {(r.doc_id, r.text) for r in found} <= set(texts)
    assert stage(rows.where("false")).count() == 0


def test_drop_copies_keeps_one_of_each_text(spark, rows):
    found = drop_copies(docs(spark, [*rows, (None, "lone", "a"), (None, "one", "a")])).collect()
    best = {}
    for i, t, _ in rows:
        best[t or ""] = max(best.get(t or "", -1), i)
    assert sorted((r.text or "", r.doc_id) for r in found if r.doc_id is not None) == sorted(best.items())
    assert [r.text for r in found if r.doc_id is None] == ["lone"]
    least = drop_copies(docs(spark, rows), keep="min").collect()
    assert sorted(r.doc_id for r in least) == sorted({(t or ""): i for i, t, _ in reversed(rows)}.values())


def test_hot_join_is_a_join(spark):
    left = spark.range(1000).selectExpr("case when id % 7 = 0 then null when id % 3 = 0 then 5 else id % 11 end as k", "id as v")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k is null or k < 8")
    want = sorted((r.k is None, r.k, r.v) for r in left.collect() if r.k is None or r.k < 8)
    assert sorted((r.k is None, r.k, r.v) for r in hot_join(left, right, ["k"], "n", 150).collect()) == want
    assert hot_join(left, right, ["k"], "n", 150, left=True).count() == 1000
    bits = bitmap(left.where("v < 50"), "v")
    assert {r.v for r in in_bitmap(left, bits, "v").where("maybe").collect()} >= set(range(50)) and in_bitmap(left, bits, "v").where("maybe").count() < 60


def test_mixing_meets_targets(spark, rows):
    got = mix_digest(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    targets = {r.source: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    assert all(r.target <= 2 * r.source_size + 1e-6 and r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) <= 1.5 * total
    again = mix_digest(docs(spark, rows).repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    mixed = mix_documents(docs(spark, rows)).collect()
    times = defaultdict(int)
    for r in mixed:
        times[r.doc_id] += 1
    assert {r.doc_id: r.taken for r in got if r.size} == {r.doc_id: times[r.doc_id] * r.size for r in got if r.size}
    assert mix_digest(docs(spark, [])).count() == 0 and mix_digest(docs(spark, [(1, None, None)])).first().taken == 0


def test_ids_are_the_librarys():
    random.seed(2)
    letters = ["a", "b", " ", "\n", "'s", "é", "1", "　", "\t", ".", "'", "ß", "Σ", "İ", "́", "  ", "<|endoftext|>", "<|startoftext|>", " <|endoftext|> ", "日本", " the", "\r\n", "\x1c", "\x85", "Ÿ"]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 14))) for _ in range(4000)]
    for name, words in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        for plain in (False, True):
            ids, t = Ids(name, words, plain), tokenizer(name)
            t.encode_special_tokens = plain
            for text in texts:
                assert ids.encode(text) == np.asarray(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def tokenizer(name):
    """The library as it comes."""
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_packing_is_whole_and_tight(spark, rows):
    got, t = packing.pack(docs(spark, rows)).collect(), tokenizer("byte_bpe_50k.json")
    want = []
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[s : first if k == 0 else s + 1024]
            want.append((i, k, s, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) == -(-sum(r.length for r in got) // 1024)
    assert packing.pack(docs(spark, [])).count() == 0


def test_fullest_is_the_best_subset():
    random.seed(4)
    for _ in range(60):
        counts = {random.randint(1, 30): random.randint(1, 3) for _ in range(5)}
        room = random.randint(1, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        got = packing.fullest(counts, room)
        assert sum(got) == max(s for s in sums if s <= room)
        assert all(got.count(k) <= counts[k] for k in got)


def test_token_store_round_trip(spark, rows, tmp_path):
    path = f"file://{tmp_path}/tokens"
    write_tokens(docs(spark, rows).repartition(3), path)
    got, t, at, want = digest(read_tokens(spark, path)).collect(), tokenizer("word_bpe_49k.json"), 0, []
    for i, text, _ in sorted(rows, key=lambda r: r[0]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got)) == want
    assert read_tokens(spark, path).where("doc_id = 12").count() == 1
    write_tokens(docs(spark, []), f"{path}-none")
    assert read_tokens(spark, f"{path}-none").count() == 0


def test_substring_dedup(spark, rows):
    more = rows + [(400 + k, "p q r " * random.randint(10, 60), "a") for k in range(5)] + [(None, "x " * 100, "a")]
    first = {}
    for i, t, _ in sorted((r for r in more if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = {}
    for i, t, _ in more:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    got = substring_dedup.drop_repeats(docs(spark, more)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want and len(got) == len(more)
    assert sum(w[1] for w in want.values()) > 500
    assert substring_dedup.drop_repeats(docs(spark, [])).count() == 0


def words5(t):
    w = (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_groups(spark, rows, monkeypatch):
    """Near copies of one text that are unlike each other: large nodes, stars that fail, heaps in several blocks."""
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    random.seed(6)
    base = [f"w{k}" for k in range(120)]
    more = list(rows)
    for k in range(70):
        w = list(base)
        for at in random.sample(range(120), random.choice([2, 3, 4, 5, 6])):
            w[at] = f"v{random.random()}"
        more.append((1000 + k, " ".join(w).upper() if k % 2 else " ".join(w), "a"))
    got = near_groups(docs(spark, more)).collect()
    sets = {i: words5(t) for i, t, _ in more}
    root = brute_components(sets)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}
    assert len(got) == len(more)


def test_near_groups_of_nothing(spark):
    assert near_groups(docs(spark, [])).count() == 0
    got = near_groups(docs(spark, [(1, None, "a"), (2, "", "a"), (3, "a b", "a"), (4, "A  B", "a")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False)]


def test_trees_meet_the_recall():
    q = near_dedup.survival()
    assert 0.4 < q < 0.7 and 1 - (1 - q) ** near_dedup.trees_for() >= near_dedup.RECALL


def test_pairs_in_large_nodes_meet():
    """Pairs at the threshold that branch in every tree down to the last level; the tokens they agree in vary by chance."""
    rng, n, trees = np.random.default_rng(12), 20_000, near_dedup.trees_for()
    a = rng.integers(0, 2**32, (n, near_dedup.TOKENS), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.75, a, ~a)
    met = np.zeros(n, bool)
    for tree in range(trees):
        ends = []
        for tokens in (b, a):
            nodes, owner = near_dedup.mixed(np.full(n, tree + 1, np.uint64)), np.arange(n)
            for _ in range(near_dedup.MOST_DEPTH):
                nodes, owner = near_dedup.branch(nodes, owner, tokens)
            ends.append(near_dedup.mixed(nodes) + near_dedup.mixed(owner.astype(np.uint64) + np.uint64(1)))
        met[owner[np.isin(ends[1], ends[0])]] = True
    assert (~met).sum() <= 10  # 2 are expected at a recall of 0.9999


def test_pii_base_and_more(spark):
    text = "Größe mail a.b@c.de. ip 10.0.0.256 and 10.0.0.1, card 4111 1111 1111 1111 or 4111 1111 1111 1112, +1 (375) 555-4393 x"
    rows = [(1, text, "a"), (2, None, "a"), (3, "", "a"), (4, "write bob [at] foo [dot] com, call (415) 555-2671 please", "a"), (5, "order 12345 of 2019-01-01, see page 12", "a")]
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, rows)).collect()}
    spans = [tuple(s.split(":")) for s in got[1].spans.split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == [("email", "a.b@c.de"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (375) 555-4393")]
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[1].base_sha256 == hashlib.sha256(got[1].spans.encode()).hexdigest()
    assert got[2].spans == got[3].spans == got[5].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].n_email == 0 and {s.split(":")[0] for s in got[4].spans.split(",")} == {"email", "phone"}
    assert pii.redact(rows[3][1]) == "write [EMAIL], call [PHONE] please"
    assert pii.find_pii(docs(spark, [])).count() == 0


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def contract_spans(text):
    """The contract's patterns as they stand, each tried everywhere."""

    def doubled(digits):
        return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(digits[::-1])) % 10 == 0

    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (
                True,
                all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True,
                14 <= len(digits) <= 19 and doubled(digits),
                10 <= len(digits) <= 15,
            )[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_pii_base_spans_are_the_contracts():
    random.seed(8)
    bits = ["1", "25", "0", "255", "256", "00", ".", ".", "-", " ", "@", "a", "b.c", "+", "+1", "(", ")", "é", "4111111111111111", "4111 1111", "x@y.z", "\n", "%", "_"]
    found = 0
    for _ in range(30000):
        text = "".join(random.choice(bits) for _ in range(random.randint(0, 22)))
        assert pii.base_spans(text) == contract_spans(text), repr(text)
        found += len(pii.base_spans(text))
    assert found > 5000


@pytest.mark.parametrize("text", ["1" * 1_000_000, "0" * 5000 + ".1.1.1", "1." * 300_000, "1 " * 300_000, "a" * 1_000_000 + "@", "a@" * 300_000, "+1" * 200_000, "+1" + "(" * 500_000, " at a" * 100_000 + " dot ", "(415) 555-2671 x " * 20_000])
def test_pii_reads_long_texts_once(text):
    selector = pii.made_up()
    began = time.time()
    base = pii.base_spans(text)
    selector.added([text[:200_000]], [[b for b in base if b[1] <= 200_000]])
    assert time.time() - began < 10


def test_pii_selection_is_precise_and_keeps_recall():
    for places in ([], [(-1, "elt mit dem ", " und dann"), (2, "zahlt mit ", ", sagt er")] * 40):
        for kind, (precision, recall) in pii.Selector(places).measure(places).items():
            assert precision > 0.9 and recall > 0.6, kind


def test_isotonic_rises():
    least, probability = pii.isotonic(np.array([0.1, 0.2, 0.3, 0.3, 0.9]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert least.tolist() == [0.1, 0.2, 0.9] and (np.diff(probability) > 0).all()


def test_chats_collapse(spark):
    turns = [(1, 0, "u", "a"), (1, 1, "b", "c"), (2, 0, "u", "a"), (3, 0, "u", "a"), (3, 1, "b", "c"), (3, 2, "u", "d"), (4, 0, "u", None), (5, 0, "u", ""), (6, 0, "u", "a"), (6, 1, "b", "c"), (6, 2, "u", "d"), (None, 3, "u", "z")]
    rows = spark.createDataFrame([(c, t, r, x, 1) for c, t, r, x in turns], "conv_id long, turn long, role string, text string, place long")
    got = {r.conv_id: (r.part, r.n_turns, r.text) for r in format_chats(rows).collect()}
    assert got == {3: (0, 3, "<|im_start|>u\na<|im_end|>\n<|im_start|>b\nc<|im_end|>\n<|im_start|>u\nd<|im_end|>\n"), 4: (0, 1, "<|im_start|>u\n<|im_end|>\n"), 5: (0, 1, "<|im_start|>u\n<|im_end|>\n"), None: (0, 1, "<|im_start|>u\nz<|im_end|>\n")}
    assert format_chats(rows.where("false")).count() == 0
    many = spark.range(2500).selectExpr("1L as conv_id", "id as turn", "'u' as role", "cast(id as string) as text")
    assert sorted((r.part, r.n_turns, r.text.count("<|im_end|>")) for r in format_chats(many).collect()) == [(0, 2500, 1024), (1, 2500, 1024), (2, 2500, 452)]


def test_drawn_takes_all_up_to_its_bound(spark):
    rows = spark.range(3000)
    assert drawn(rows, 3000, "id").count() == 3000 and drawn(rows, 5000, "id").count() == 3000
    assert 1000 < drawn(rows, 2000, "id").count() <= 2000 and drawn(rows.limit(0), 5, "id").count() == 0


def test_new_ascii_words_need_no_pattern():
    """ASCII letters, alone or before one mark, are split without the tokenizer's pattern, and have the library's ids."""
    encoder = Ids("word_bpe_49k.json", True)
    text = "Zqwopt zqwopt, ZQWOPT! zq' Zq. (zq) zq_ zq- it's zq"
    plain = [w for w in text.split() if w not in ("(zq)", "it's")]
    encoder.split = None
    got = encoder.encode(" ".join(plain))
    assert np.frombuffer(got, "<u4").tolist() == encoder.tokenizer.encode(" ".join(plain), add_special_tokens=False).ids
    whole = Ids("word_bpe_49k.json", True)
    assert np.frombuffer(whole.encode(text), "<u4").tolist() == whole.tokenizer.encode(text, add_special_tokens=False).ids
    marks = " ".join(f"aQz{chr(m)}" for m in range(33, 127))
    assert np.frombuffer(whole.encode(marks), "<u4").tolist() == whole.tokenizer.encode(marks, add_special_tokens=False).ids
