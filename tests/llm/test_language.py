"""Languages: held-out rows, spans of mixed texts, scripts, the path against a plain Viterbi, odd rows."""

import zlib

import duckdb
import numpy as np
import pytest

from pointloom.llm import language
from pointloom.llm.language import label, languages, learn, viterbi

SMALL = "/root/testdata/sf0.01/documents.parquet"
VOICES = {
    "en": "the quick house is there with others when nothing shows which words they should have thought through",
    "de": "der schnelle hund und die katze sind nicht auf dem dach weil schnee zwischen straßen über brücken fällt",
    "ru": "быстрый дом стоит там где никто не видел слова которые они должны были думать вчера вечером",
    "uk": "швидкий будинок стоїть там де ніхто її не бачив слова які вони повинні були думати вчора ввечері",
    "ja": "これは 日本語 の テスト です 東京 へ 行きます",
}


def voice(rng, lang, n):
    return " ".join(rng.choice(VOICES[lang].split(), n))


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(5)
    rows = [(k * 7 + j, voice(rng, lang, 60), lang) for k in range(40) for j, lang in enumerate(VOICES)]
    return learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out_rows_of_the_table(spark):
    got = {r.doc_id: r for r in languages(spark.read.parquet(SMALL)).collect()}
    truth = dict(duckdb.sql(f"select doc_id, lang from '{SMALL}'").fetchall())
    assert set(got) == set(truth)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i in truth if got[i].held_out and truth[i]]
    assert len(held) > 250 and np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.98


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = spark.read.parquet(SMALL)
    other = rows.withColumn("lang", language.F.when(language.held_out(language.F.col("doc_id")), "xx").otherwise(language.F.col("lang")))
    assert sorted(languages(rows).collect()) == sorted(languages(other).collect())


def test_spans_of_mixed_texts(spark, model):
    rng = np.random.default_rng(6)
    parts = [("en", voice(rng, "en", 30)), ("de", voice(rng, "de", 20)), ("ru", voice(rng, "ru", 25)), ("en", voice(rng, "en", 12))]
    text = "\n".join(p for _, p in parts)
    got = label(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s.lang for s in got.spans] == [lang for lang, _ in parts] and got.lang_pred == "en"
    assert 0.3 < got.score < 0.7  # less than half of the letters are English
    at = 0
    for s, (_, p) in zip(got.spans, parts, strict=True):
        assert abs(s.start - at) < 25 and abs(s.end - at - len(p)) < 25  # a word or two that both languages might have
        at += len(p) + 1


def test_scripts_narrow(spark, model):
    rows = [(1, "дом"), (2, "її"), (3, "東京"), (4, "ελληνικά"), (5, "der ДОМ und die katze")]
    got = {r.doc_id: r for r in label(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1].lang_pred in ("ru", "uk") and got[2].lang_pred == "uk" and got[3].lang_pred == "ja"
    assert got[4].lang_pred in VOICES  # no learned language uses the script: still one of them
    assert got[5].lang_pred == "de" and {s.lang for s in got[5].spans} >= {"de"}
    assert model.uses[list(language.SCRIPTS).index("cyrillic") + 1] == sum(1 << model.langs.index(x) for x in ("ru", "uk"))


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, " 12 ½ ² _ \n"), (4, "a"), (None, "the house"), (4, "der hund"), (5, "the house " * 40_000), (6, "́́"), (7, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, "en", 3, "s") for i, t in rows], "doc_id long, text string, lang string, score long, spans string")
    got = label(docs, model).collect()
    assert len(got) == len(rows)
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3, 6)] == ["und"] * 4 and all(r.score == 0 and not r.spans for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in got if r.doc_id in (None, 5)} == {"en"}
    assert [(s.start, s.end) for r in got if r.doc_id == 5 for s in r.spans] == [(0, 399_999)]
    none = languages(docs.where("false"))
    assert none.count() == 0 and none.columns == ["doc_id", "held_out", "lang_pred", "score", "n_spans"]
    unlabelled = languages(docs.drop("lang").withColumn("lang", language.F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"} and len(unlabelled) == len(rows)


def test_words_alike_or_not_score_alike(model):
    text = "the house der hund the house дом дом"
    points, _ = language._points([text])
    begin, end = language._words(points)
    assert np.allclose(model.words(points, begin, end), model._each(points, begin, end))


def plain(scores, prior, switch):
    """The best total by trying every last language, word by word."""
    value = [p + s for p, s in zip(prior, scores[0], strict=True)]
    for row in scores[1:]:
        value = [max(v - (switch if j != k else 0) for j, v in enumerate(value)) + s for k, s in enumerate(row)]
    return max(value)


@pytest.mark.parametrize("switch", [0.5, 2.0, 8.0])
def test_path_is_the_best(switch):
    rng = np.random.default_rng(9)
    for _ in range(60):
        sizes = rng.integers(1, 30, rng.integers(1, 7))
        scores = -rng.random((sizes.sum(), 3)).astype(np.float32) * rng.choice([0.3, 6.0], (sizes.sum(), 1)).astype(np.float32)
        starts, prior = np.cumsum(sizes) - sizes, -rng.random(3)
        path = viterbi(scores, starts, prior, switch)
        for a, n in zip(starts, sizes, strict=True):
            own, s = path[a : a + n].astype(int), scores[a : a + n].astype(float)
            total = prior[own[0]] + s[np.arange(n), own].sum() - switch * (np.diff(own) != 0).sum()
            assert total == pytest.approx(plain(s.tolist(), prior.tolist(), switch), abs=1e-5)
