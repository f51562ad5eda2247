"""Texts of over 2 MiB, longer than any chunk, block or piece that an operator reads at once, beside short ones."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrie.llm import decontaminate, html_extract, jaccard, langid, lm_score, mixing, pii, suffix_dedup, toxicity
from corrie.llm.common import Scratch
from corrie.llm.textnp import prefix_hash, span_hash

g = np.random.default_rng(21)
VOCABULARY = ["".join(map(chr, g.integers(97, 123, int(n)))) for n in g.integers(2, 10, 60000)]


def words(n):
    return [VOCABULARY[i] for i in g.integers(0, len(VOCABULARY), n)]


BIG = words(420_000)
PASSAGE = " ".join(words(60))
EMAIL = "bob.x@host.example.com"
TEXTS = {
    1: " ".join([*BIG, PASSAGE, EMAIL, "end"]),
    2: " ".join([*BIG[:200_000], "changed", *BIG[200_001:], PASSAGE]),
    3: " ".join([*words(50), PASSAGE, *words(20)]),
    4: " ".join(words(80)),
    5: "a" * 2_200_000,
    6: " \n" * 1_200_000,
}


@pytest.fixture(scope="module")
def docs(spark):
    assert all(len(TEXTS[i]) > 1 << 21 for i in (1, 2, 5, 6))
    return spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "s", len(t)) for i, t in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_language(docs):
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert [got[i]["lang_pred"] == "und" for i in sorted(TEXTS)] == [False] * 5 + [True]
    assert got[5]["lang_pred"] == "en" and got[2]["lang_pred"] in ("en", "fr")


def test_lm(docs):
    got = {r["doc_id"]: r for r in lm_score.score_corpus(docs, ["doc_id"], rounds=1).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(t.split()) for i, t in TEXTS.items()}
    assert all(r["logprob"] < 0 and np.isfinite(r["logprob"]) for i, r in got.items() if i != 6) and got[6]["logprob"] == 0


def test_toxicity_by_formula(docs):
    """A document's score is the sigmoid of the bias and the mean over its distinct words of the mean of their n-grams' log-odds."""
    model = toxicity.Model(np.random.default_rng(1).standard_normal(1 << toxicity.BITS).astype(np.float32) * 30, -0.3)
    h = lambda b: int(span_hash(prefix_hash(np.frombuffer(b, np.uint8)), np.array([0]), np.array([len(b)]))[0]) >> 64 - toxicity.BITS
    own = {}

    def word(w):
        if w not in own:
            b = b"\x01" + w + b"\x02"
            bins = [h(b[i : i + n]) for n in toxicity.ORDERS for i in range(len(b) - n + 1)] + [h(b)]
            own[w] = float(np.mean([model.bins[x] for x in bins]))
        return own[w]

    for i, t in toxicity.score(docs, model).select("doc_id", "tox_score").collect():
        if i in (5,):
            continue  # one word of 2 MB
        found = {*re.findall(rb"[a-z0-9@$\x80-\xff]+", TEXTS[i].lower().encode())}
        z = model.bias + sum(map(word, found)) / (toxicity.BLANKS + len(found))
        assert abs(t - 1 / (1 + np.exp(-z))) < 1e-4, i


def test_jaccard(docs):
    assert sorted(r[0] for r in jaccard.one_of_each(docs).select("doc_id").collect()) == [1, 3, 4, 5, 6]


def test_html(spark):
    page = f"<body><nav><a href=x>{PASSAGE}</a></nav><article><p>{TEXTS[1]}</p><p>Of.</p></article><div>{PASSAGE}</div>"
    df = spark.createDataFrame([(1, page), (2, "<p>" * 700_000 + "x"), (3, "<p>short")], "page_id long, html string")
    got = {r["page_id"]: r["main_text"] for r in html_extract.extract(df).collect()}
    assert got == {1: f"{TEXTS[1]} Of.", 2: "x", 3: "short"}


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")
    got = {r["doc_id"]: (r["_n_words"], r["_items"]) for r in decontaminate.hits(docs, bench).collect()}
    assert [i for i in sorted(got) if got[i][1] == ["7"]] == [1, 2, 3] and got[4] == (80, [])
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut[3] == TEXTS[3].replace(PASSAGE, "") and cut[1] == TEXTS[1].replace(PASSAGE, "") and cut[5] == TEXTS[5]


def test_dedup(spark, docs):
    small = docs.filter("doc_id IN (1, 3, 4, 6)").unionByName(docs.filter("doc_id = 5").withColumn("text", F.lit("a" * 5000)))
    got = {r["doc_id"]: suffix_dedup._runs([{"lo": np.ascontiguousarray(x[:, 0]).tobytes(), "hi": np.ascontiguousarray(x[:, 1]).tobytes()}] if len(x := np.frombuffer(r["removed"], "<i8").reshape(-1, 2)) else None).tolist() for r in suffix_dedup.dedup(small, Scratch(spark)).collect()}
    at = {i: TEXTS[i].index(PASSAGE) for i in (1, 3)}
    for i in (1, 3):
        assert len(got[i]) == 1 and 0 <= at[i] - got[i][0][0] <= 1 and 0 <= got[i][0][1] - at[i] - len(PASSAGE) <= 1
    assert got[4] == [] and got[5] == [[0, 5000]] and got[6] == [[0, len(TEXTS[6])]]


def test_pii(docs):
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["base"]] for r in pii.find(docs, pii.train(docs, steps=2)).collect()}
    at = TEXTS[1].index(EMAIL)
    assert got == {i: [("email", at, at + len(EMAIL))] if i == 1 else [] for i in TEXTS}


def test_mixing(docs):
    sha = {hashlib.sha256(t.encode()).hexdigest() for t in TEXTS.values()}
    got = mixing.replicate(docs, default_weight=1.0).select("doc_id", F.sha2("text", 256).alias("sha")).collect()
    assert got and {r["sha"] for r in got} <= sha
