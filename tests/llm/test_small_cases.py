"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from skyframe.llm import decontaminate, html_text, lattice_lm, near_dedup, packing, pii, quality, toxicity, url_filter, vector_dedup

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = ["", None, " \t\n", "one", "x" * 60_000, "1" * 50_000, "." * 20_000, LONG, "naïve 東京 ünï 🙂", "a b c d e f g", "a b c d e f g"]
EXTRA = ["score", "spans", "token", "n", "row", "rep", "vec", "cell", "label", "class_id", "verdict", "id", "_text", "salt", "gone", "_gone", "again", "_again", "terms", "bucket", "component", "own"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(ODD)] + [(3, "one", "en", "s", 3), (None, "null id words here now", "en", "s", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit(1) for c in EXTRA})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(11)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(0, "a b c d e f g"), (1, None), (2, ""), (3, "a b"), (4, "a b c d e f g")], "item_id long, text string")


PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")

OPERATORS = {
    "quality": lambda d, l, b: quality.quality(d, l),
    "near_duplicates": lambda d, l, b: near_dedup.near_duplicates(d),
    "lattice": lambda d, l, b: lattice_lm.score_documents(d, PIECES),
    "toxicity": lambda d, l, b: toxicity.toxicity(d, l),
    "pii": lambda d, l, b: pii.find_pii(d),
    "packing": lambda d, l, b: packing.pack_documents(d, BYTES),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_row_whatever_it_holds(docs, clashing, labels, bench, name):
    run = OPERATORS[name]
    got = run(clashing, labels, bench)
    rows = got.collect()
    if name == "packing":
        rows = [r for r in rows if r.piece == 0]
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    assert not any(isinstance(v, float) and np.isnan(v) for r in rows for v in r)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(docs, labels, bench, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0), bench.limit(0)).count() == 0
    if name in ("quality", "toxicity"):
        assert OPERATORS[name](docs, labels.limit(0), bench).count() == docs.count()


def test_leaks(docs, clashing, bench):
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(clashing, bench).collect()}
    assert got == {(9, 0), (9, 4), (10, 0), (10, 4)}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    left = decontaminate.drop_leaks(clashing, bench)
    assert left.columns == clashing.columns and left.count() == docs.count() - 2
    sliced = decontaminate.find_leaks(docs, bench, bytes_at_once=8)
    assert {(r.doc_id, r.item_id) for r in sliced.collect()} == got
    assert decontaminate.drop_leaks(docs, bench.limit(0)).count() == docs.count()


@pytest.mark.parametrize("kind", ["smallint", "decimal(9,0)", "date", "string"])
def test_short_items_and_ids_of_any_type(docs, bench, kind):
    ids = F.col("item_id") if kind != "date" else F.date_add(F.lit("2020-01-01").cast("date"), F.col("item_id").cast("int"))
    short = bench.withColumn("text", F.when(F.col("item_id") == 3, "One!").otherwise(F.col("text"))).withColumn("item_id", ids.cast(kind))
    got = decontaminate.find_leaks(docs, short)
    assert got.schema["item_id"].dataType == short.schema["item_id"].dataType
    rows = got.collect()
    assert sorted((r.doc_id, r.coverage) for r in rows if r.doc_id < 9) == [(3, 1.0), (3, 1.0)] and len({r.item_id for r in rows}) == 3


def test_stages_keep_columns(clashing, labels):
    for out in (toxicity.drop_toxic(clashing, labels), near_dedup.keep_one(clashing), pii.redact(clashing)):
        assert sorted(out.columns) == sorted(clashing.columns)
    once = near_dedup.keep_one(clashing)
    ids = [r.doc_id for r in once.select("doc_id").collect()]
    assert ids.count(3) == 1 and 9 in ids and 10 not in ids and None in ids


def test_stages_on_empty_tables(clashing, labels, bench):
    none = clashing.limit(0)
    for out in (toxicity.drop_toxic(none, labels), toxicity.drop_toxic(none, labels.limit(0)), near_dedup.keep_one(none), pii.redact(none), decontaminate.drop_leaks(none, bench)):
        assert out.count() == 0 and out.columns == clashing.columns
    assert packing.pack_documents(none, BYTES).count() == 0
    assert toxicity.drop_toxic(clashing, labels.limit(0)).count() == clashing.count()


def test_urls(spark):
    urls = [None, "", "no scheme casino", "http://", "http://A.Example.COM/en/7x?q=1#f", "https://x.com/EN/1", "https://notcom/en/1", "ftp://example.net:80/de/8", "http://example.net/de/81", "x://casino.org/a", "http://a.b/freebets", "http://a.b/free-bets",
            "http://a.b/ok?x=casino", "http://example.org/es/?casino"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("z") for c in ("host", "rule", "verdict", "strict", "terms", "_terms")})
    assert {"terms", "_terms"} <= set(url_filter.judge_urls(df).columns)
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert [got[i].host for i in (0, 2, 3, 4, 7)] == ["", "", "", "a.example.com", "example.net:80"]
    assert (got[4].path, got[4].rule, got[4].verdict) == ("/en/7x", "example.com/en/7", "allow")
    assert got[5].rule is None and got[6].rule is None and got[7].rule is None
    assert (got[8].rule, got[8].verdict) == ("example.net/de/8", "block")
    assert [got[i].verdict for i in (0, 1, 2, 9, 10, 11, 12, 13)] == ["allow", "allow", "block", "block", "allow", "block", "block", "block"]
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_pages(spark):
    pages = [None, "", "<", "<p>", "plain words only, no markup at all", "<article><p>A&amp;B &lt;x&gt; &am <b>bold<br><p>two</article>", "<div>" * 3000 + "deep " * 40 + "</div>" * 10, "<script>var a='<p>no</p>'</script><article><p>yes</p></article>",
             "<article><p>one<br>two<br><br>three<br>\n<br>four</p></article>", "<!-- <p>no</p> --><main><h2>T</h2><p>x  y\n z</p><div class='comments'><p>no no</p></div></main><aside>no</aside>"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumns({"Text": F.lit("z"), "n_chars": F.lit("z"), "_html": F.lit("q"), "page": F.lit("p")})
    assert html_text.extract_text(df).columns == ["page_id", "html", "_html", "page", "text", "n_chars"]
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert got[0] == got[1] == "" and got[5] == "A&B <x> &am bold\n\ntwo" and got[7] == "yes" and got[8] == "one two\n\nthree\n\nfour" and got[9] == "T\n\nx y z"
    assert all(r.n_chars == len(r.text) for r in html_text.extract_text(df).collect())


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [[1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 0.0], None, [], [nan, 1.0], [inf, 1.0], [None, 1.0], [0.9, 0.1], [1.0, 0.0, 0.0], [1.0, 0.0, 0.01], [0.0, -1.0], [1e30, 1e-30]]
    df = spark.createDataFrame(list(enumerate(v)) + [(None, [1.0, 0.0])], "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("cell", "vec", "n", "rep", "label")})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.link_vectors(df).collect()}
    assert [got[i] for i in (0, 1, 2, 9, 13)] == [(4, 0, True), (4, 0, False), (4, 0, False), (4, 0, False), (4, 0, False)]
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 12)) and got[10] == (1, 10, True) and got[11] == (1, 10, False) and got[None] == (0, None, True)
    assert vector_dedup.link_vectors(df.limit(0)).count() == 0
