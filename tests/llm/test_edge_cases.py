"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corrie.llm import decontaminate, html_extract, jaccard, kdtree, langid, lm_score, mixing, pii, suffix_dedup, toxicity
from corrie.llm.common import Scratch

WORDS = "river stone cloud green table window paper light music winter summer garden bridge corner letter number".split()
CLASHING = ("k", "_k", "_key", "r", "n", "comp", "lang_pred", "lang_score", "tox_score", "pii", "removed", "_spans", "spans", "copy", "mix_order", "_n_words", "_hits", "_items", "n_tokens", "logprob", "mean_logprob", "main_text", "at", "_source", "_rate", "_n", "_at", "_salt")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n):
    g = random.Random(seed)
    return " ".join(g.choice(WORDS) + g.choice(["", "s", "ing"]) for _ in range(n))


ROWS = [
    (1, text(1, 60), "en", "a", 1),
    (2, text(1, 60), "en", "a", 1),
    (2, text(1, 60), "en", "a", 1),
    (3, text(1, 59) + " ünïcode", None, None, None),
    (4, None, "en", "a", None),
    (5, "", "en", "b", 0),
    (6, " \t\n", None, "b", 3),
    (7, "12345 --- 67", "en", "a", 12),
    (8, text(8, 30000), "en", "a", None),
    (None, text(9, 40), "fr", None, None),
    (None, None, None, None, None),
    (9, "one two three", "en", "a", 13),
    (10, "One two  three", "en", "a", 14),
    (11, "mail bob.x@host.example.com or +44 (20) 7946-0958 from 10.1.2.255", "en", "a", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, text(1, 12)), (2, None), (3, ""), (4, "One, two!"), (None, "zebra")], "item_id long, text string")


def by_id(df, *cols):
    return sorted((tuple(r) for r in df.select("doc_id", *cols).collect()), key=str)


def test_language(docs, empty):
    model = langid.train(docs)
    got = by_id(langid.identify(docs, model), "lang_pred", "lang_score", "k")
    assert len(got) == len(ROWS) and all(r[3] == "x" for r in got)
    assert {r[1] for r in got if r[0] in (4, 5, 6, 7)} == {"und"}
    assert all(0 <= r[2] <= 1 for r in got)
    assert langid.identify(empty, model).count() == 0
    assert {r[1] for r in by_id(langid.identify(docs, langid.train(empty)), "lang_pred")} == {"und"}


def test_lm(docs, empty):
    model = lm_score.train(docs, rounds=1)
    got = {r[0]: r[1:] for r in by_id(lm_score.score(docs, model), "n_tokens", "logprob", "mean_logprob")}
    assert got[4] == got[5] == got[6] == (0, 0.0, 0.0)
    assert got[8][0] == 30000 and got[8][1] < 0
    assert lm_score.score(empty, lm_score.train(empty, rounds=1)).count() == 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0), (2, 0), (9, 1), (8, None), (None, 1), (9, 1), (4, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = by_id(toxicity.score(docs, model), "tox_score")
    assert len(got) == len(ROWS) and all(0 <= r[1] <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    assert {r[1] for r in by_id(toxicity.score(docs, toxicity.train(docs, labels.limit(0))), "tox_score")} == {0.0}


def test_jaccard(docs, empty):
    kept = by_id(jaccard.one_of_each(docs), "text", "k")
    ids = [r[0] for r in kept]
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids  # one group
    assert ids.count(9) == 1 and 10 not in ids  # equal words
    assert {4, 5, 6, 7, 8, 11} <= set(ids) and ids.count(None) == 2
    assert all(r[2] == "x" for r in kept)
    assert jaccard.one_of_each(empty).count() == 0


def test_decontamination(docs, empty, bench):
    got = {r[0]: r for r in decontaminate.hits(docs, bench).select("doc_id", "_n_words", "_items", "k").collect() if r[0] is not None}
    assert got[1][2] == ["1"] and got[9][2] == ["4"] and got[4][1] == got[5][1] == 0 and got[8][1] == 30000
    cut = {r[0]: r[1] for r in by_id(decontaminate.remove_spans(docs, bench), "text")}
    assert len(cut[1]) < len(ROWS[0][1]) and cut[4] is None and cut[7] == ROWS[7][1]
    assert 9 not in cut  # two of its three words
    assert decontaminate.remove_spans(empty, bench).count() == 0
    assert decontaminate.remove_spans(docs, bench.limit(0)).count() == len(ROWS)


def test_dedup(spark, docs, empty):
    got = [r for r in suffix_dedup.dedup(docs, Scratch(spark)).select("doc_id", "text", "removed", "k").collect()]
    assert len(got) == len(ROWS)
    runs = {r[0]: r[2] for r in got}
    assert all(len(runs[i]) == 16 for i in (1, 2, 3)) and all(len(runs[i]) == 0 for i in (4, 5, 6, 7, 9))
    assert suffix_dedup.dedup(empty, Scratch(spark)).count() == 0


def test_pii(docs, empty):
    model = pii.train(docs, steps=3)
    got = {r[0]: r[1] for r in pii.find(docs, model).select("doc_id", "pii").collect()}
    assert [(s["kind"], s["base"]) for s in got[11] if s["base"]] == [("email", True), ("ip", True), ("phone", True)]
    assert got[4] == got[5] == []
    red = {r[0]: r[1] for r in by_id(pii.redact(docs, None), "text")}
    assert red[11] == "mail [EMAIL] or [PHONE] from [IP]" and red[4] is None and red[8] == ROWS[8][1]
    assert pii.redact(empty, pii.train(empty)).count() == 0


def test_mixing(docs, empty):
    got = mixing.replicate(docs)
    assert {"copy", "mix_order", "k", "text"} <= set(got.columns) and len(got.columns) == len(docs.columns)
    first = sorted(map(str, got.collect()))
    assert first == sorted(map(str, mixing.replicate(docs.repartition(5)).collect()))
    assert mixing.replicate(empty).count() == 0
    assert {r[0] for r in mixing.replicate(docs, {"a": 0.0}).select("source").distinct().collect()} <= {"b", None}


def test_html(spark):
    page = "<body><nav>menu</nav><article><p>" + "long &amp; text " * 20000 + "</article>"
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>short"), (4, "u", page), (4, "u", page), (None, "u", "<!-- open <p>x"), (5, "u", "plain")], "page_id long, url string, html string").withColumn("main_text", F.lit(1)).withColumn("text", F.lit("x"))
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert [got[i]["main_text"] for i in (1, 2, 3, None, 5)] == ["", "", "short", "", "plain"]
    assert got[4]["main_text"] == " ".join(["long & text"] * 20000) and got[4]["text"] == "x"
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_keeps_the_whole_article():
    long = "long enough to be a surge of its own in any window of blocks"
    links = "<p><a href=x>one</a></p><p><a href=x>two</a></p><p><a href=x>three</a></p>"
    menu = "<div><a href=x>menu</a></div>"
    assert html_extract.main_text("<article><h1><a href=x>Title</a></h1><p>Body</p></article>") == "Title Body"
    assert html_extract.main_text(f"<p>outside</p><main><p>{long}</p>{links}<p>The end.</p></main>") == f"{long} one two three The end."
    assert html_extract.main_text(f"<article><p>{long}</p><p><a href=x>Read on</a></p></article>{menu}") == f"{long} Read on"
    assert html_extract.main_text(f"{menu}<h1><a href=x>Title</a></h1><p>{long}</p><p><a href=x>Read on</a></p>{menu}") == f"Title {long} Read on"


def test_html_names_of_ordinary_pages():
    body = "<p>Some words about a river and the stones in it.</p>"
    kept = "Some words about a river and the stones in it."
    for attrs in ('class="post has-sidebar"', 'id="side-effects"', 'class="entry ad-free"', 'class=commentary'):
        assert html_extract.main_text(f"<article {attrs}>{body}</article>") == kept
        assert html_extract.main_text(f"<article><section {attrs}>{body}</section></article>") == kept
    for attrs in ('class="ad"', 'class="comment-list"', 'id=cookieBanner', 'role="navigation"', 'class="x share-buttons"'):
        assert html_extract.main_text(f"<article>{body}<div {attrs}><p>Buy this.</p></div></article>") == kept


def test_html_takes_linear_time():
    for unit in ("<p><b>x<i></p>", "<a ", '<a "', "<a '\">", "<nav><article>x</article>", "<div>x", "<!--", "<b></i>"):
        began = time.time()
        html_extract.main_text(unit * 100_000)
        assert time.time() - began < 10, unit  # in quadratic time, minutes


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (50, []), (100, []), (None, [9.0, 9.0]), (150, [-0.5, 0.001])]
    v = kdtree.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("x")))
    got = sorted(tuple(r) for r in kdtree.top_k(v, v.filter("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 2, 65536), (0, 4, 150, -32768), (50, 1, 100, 0), (100, 1, 50, 0), (150, 1, 0, -32768), (150, 2, 1, -32768), (150, 3, 2, -32768), (150, 4, 2, -32768)]
    assert kdtree.top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_k_beyond_longs(spark):
    """Components and scores are the nearest longs; ties among these go to the smaller vec_id."""
    most = (1 << 63) - 1
    rows = [(0, [1e12, 1.0]), (1, [1e12, 0.0]), (2, [1e300, 0.0]), (3, [-1e12, 5.0]), (4, [0.0, 2.0]), (50, [0.0, 1.0])]
    v = kdtree.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in kdtree.top_k(v, v.filter("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 1, most), (0, 2, 2, most), (0, 3, 4, 131072), (0, 4, 50, 65536), (0, 5, 3, -most - 1), (50, 1, 3, 327680), (50, 2, 4, 131072), (50, 3, 0, 65536), (50, 4, 1, 0), (50, 5, 2, 0)]


def test_pipeline(spark, docs, empty, bench, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, rows in (("some", docs), ("none", empty)):
        sf = tmp_path / name
        rows.write.parquet(str(sf / "documents.parquet"))
        bench.write.parquet(str(sf / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(sf))
        assert got.columns == [c for c in docs.columns if c not in ("copy", "mix_order")] + ["copy", "mix_order"]
        found = got.collect()
        if name == "none":
            assert not found
            continue
        assert all(r["k"] == "x" and r["lang"] in ("en", "fr") and r["n_chars"] == len(r["text"]) for r in found)
        assert not {r["doc_id"] for r in found} & {2, 3, 4, 5, 6, 7, 9, 10}  # copies, without letters, and the benchmark's own
        assert {r["doc_id"] for r in found} <= {1, 8, 11, None}
    stages = dict(corpus_pipeline.STAGES)
    assert stages["language ID"](spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == len(ROWS)
