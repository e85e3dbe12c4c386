"""Language identification: held-out accuracy, what decides, and the edges."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.llm import language
from skyframe.llm.queries import op13_family_svm


@pytest.fixture(scope="module")
def judged(spark, data):
    return op13_family_svm(spark, data).collect()


def test_held_out_accuracy(spark, data, judged):
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in judged)
    kept = [r for r in judged if r["held_out"]]
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in kept]
    assert len(judged) == len(truth) and len(kept) > 30 and np.mean(right) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in judged) and np.mean([r["score"] for r in kept]) > 0.7


def test_plain_counts():
    text = "Ab  c! ÀB\n" * 3 + "1"
    used, values = language.features(text)
    plain = " ab c àb ab c àb ab c àb "
    grams = Counter(plain[k : k + n] for n in (1, 2, 3) for k in range(len(plain) - n + 1))
    assert np.allclose(sorted(np.round(values**2 * grams.total())), sorted(grams.values())) and np.isclose((values**2).sum(), 1)


def test_slices_count_each_run_once(monkeypatch):
    text = "the quick brown fox über die straße " * 50
    whole = language.features(text)
    monkeypatch.setattr(language, "SLICE", 7)
    sliced = language.features(text)
    assert (whole[0] == sliced[0]).all() and np.allclose(whole[1], sliced[1])


def test_machine_separates_as_brute_force():
    rng = np.random.default_rng(3)
    x = np.hstack([rng.normal(size=(60, 4)), np.ones((60, 1))])
    y = np.where(x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.normal(size=60) > 0.2, 1, -1)
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    loss = lambda w: 0.5 * 1e-3 * w @ w + 0.5 * (share * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    w = language.separate(x, y)
    slow = np.zeros(5)
    for _ in range(30_000):
        slow -= 0.3 * (1e-3 * slow - x.T @ (share * y * np.maximum(0, 1 - y * (x @ slow))))
    assert np.isclose(loss(w), loss(slow), atol=1e-6) and np.allclose(w, slow, atol=1e-3)


def words(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))


def test_family_first_then_duels_inside(spark):
    rng = np.random.default_rng(0)
    made = {"nl": ["aan", "ij", "oe", "ge"], "sv": ["aan", "ö", "oe", "ge"], "da": ["aan", "ø", "oe", "ge"], "pt": ["ção", "lh", "ai"], "it": ["zione", "gl", "ai"], "xx": ["qq", "zz"]}
    rows = [(k, words(rng, made[lang], int(rng.integers(5, 40))), lang) for k, lang in enumerate(list(made) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, held_out=language.default_held_out())
    assert model.groups == {"germanic": ["da", "nl", "sv"], "romance": ["it", "pt"], "xx": ["xx"]} and len(model.pairs) == 3 + 3 + 1
    out = {r["doc_id"]: r for r in language.identify(df).collect()}
    assert np.mean([out[k]["lang_pred"] == lang for k, _, lang in rows if out[k]["held_out"]]) > 0.95


def test_edges(spark):
    rows = [(k, f"the and of {k} ing", "en") for k in range(12)] + [(k, f"der und ß ung {k}", "de") for k in range(12, 24)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "123 !?", "en"), (None, "the of", None), (None, None, None), (103, "the and of ing", None), (103, "the and of ing", None), (104, "der und ß ung " * 100_000, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumns({"label": F.lit(1), "turn": F.lit(2), "_text": F.lit("x")})
    out = language.identify(df).where("doc_id >= 100 OR doc_id IS NULL").collect()
    got = sorted((str(r["doc_id"]), r["lang_pred"], r["score"] > 0) for r in out)
    assert got == [("100", "und", False), ("101", "und", False), ("102", "und", False), ("103", "en", True), ("103", "en", True), ("104", "de", True), ("None", "en", True), ("None", "und", False)]
    assert not [r for r in out if r["doc_id"] is None and r["held_out"]]


def test_nothing_to_learn(spark):
    kinds = "doc_id long, text string, lang string"
    assert language.identify(spark.createDataFrame([], kinds)).count() == 0
    assert language.identify(spark.createDataFrame([(1, "word", None)], kinds)).first()[2:] == ("und", 0.0)
    only = [(k, f"word {k}", "en") for k in range(9)]
    assert {tuple(r)[2:] for r in language.identify(spark.createDataFrame(only, kinds)).collect()} == {("en", 1.0)}


def test_labels_of_held_out_rows_play_no_part(spark, data, judged):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    lied = docs.withColumn("lang", F.when(language.default_held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert sorted(map(tuple, language.identify(lied).collect())) == sorted(map(tuple, judged))
