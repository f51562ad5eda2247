"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a run of letters, digits, @ and $ after lower-casing A-Z; its vector is the mean of the vectors of its hashed
character n-grams (3 to 5 bytes, with bounds) and of itself, a document's vector the mean of its distinct words' vectors
and BLANKS blank ones, so an
unseen misspelling shares most of its vector with the word it comes from. Embeddings and softmax are trained together by
full-batch Adam on a bounded sample of labelled rows, at most about `docs_per_class` of each label, chosen by a hash of
the doc_id. N-grams of fewer than MIN_DOCS texts of the sample get no vector of their own: with so little seen of them
they would learn their texts by heart. DIM, RATE and STEPS were chosen on a third of the training rows. Since both layers are linear, a trained model keeps one number for each n-gram bin; scoring sums them over
whole texts in chunks.

Edge cases: a null, empty or word-free text has the score of an empty bag (the bias alone); without rows of both labels
every score is 0; a document with several label rows trains once for each; rows are scored one by one, so repeated rows
agree; an empty table gives no rows; other columns pass (`tox_score` is replaced).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, small_batches, table, text_buffers
from .textnp import ALNUM, LOWER, prefix_hash, span_hash, words

BITS = 18
DIM = 4
SCALE = 4000.0
RATE = 0.15
MIN_DOCS = 10
BLANKS = 8  # words without a meaning that every average holds, so a few words don't make an extreme
FLOOR = 0.02  # of the largest gradient: n-grams of small gradients take small steps
ORDERS = (3, 4, 5)
DOCS_PER_CLASS = {0: 3000, 1: 800}
STEPS = 100
THRESHOLD = 0.7
WORD = ALNUM.copy()
WORD[[0x24, 0x40]] = True


def _subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the n-grams of each word and of the word itself, and each word's offset into them."""
    size = ends - starts + 2
    offs = np.r_[0, np.cumsum(size)]
    buf = np.empty(offs[-1], np.uint8)
    buf[offs[:-1]], buf[offs[1:] - 1] = 1, 2
    inner = np.ones(offs[-1], bool)
    inner[offs[:-1]] = inner[offs[1:] - 1] = False
    shift = np.repeat(starts - offs[:-1] - 1, size)
    at = np.arange(offs[-1])
    buf[inner] = data[(at + shift)[inner]]
    last = np.repeat(offs[1:], size)
    c = prefix_hash(buf)
    bins, owner = [], []
    word = np.repeat(np.arange(len(starts)), size)
    for n in ORDERS:
        ok = at[at + n <= last]
        bins.append(span_hash(c, ok, ok + n) >> np.uint64(64 - BITS))
        owner.append(word[ok])
    bins.append(span_hash(c, offs[:-1], offs[1:]) >> np.uint64(64 - BITS))
    owner.append(np.arange(len(starts)))
    bins, owner = np.concatenate(bins).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return bins[order], np.searchsorted(owner[order], np.arange(len(starts) + 1))


class Model:
    """bins: the log-odds that each n-gram bin gives; bias."""

    def __init__(self, bins: np.ndarray, bias: float) -> None:
        self.bins, self.bias = bins, bias

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = np.full(len(offs) - 1, self.bias)
        for i, j in chunks(offs):
            part = LOWER[data[offs[i] : offs[j]]]
            starts, ends, wo = words(part, offs[i : j + 1] - offs[i], WORD)
            if not len(starts):
                continue
            _, first, at = np.unique(span_hash(prefix_hash(part), starts, ends), return_index=True, return_inverse=True)
            bins, bo = _subwords(part, starts[first], ends[first])
            word = np.add.reduceat(self.bins[bins], bo[:-1]) / np.diff(bo)
            pair = np.unique(np.repeat(np.arange(j - i), np.diff(wo)) * np.int64(len(first)) + at)
            doc = pair // len(first)
            out[i:j] += np.bincount(doc, word[pair % len(first)], j - i) / (BLANKS + np.bincount(doc, minlength=j - i))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit(texts: list[str], labels: list[int], steps: int = STEPS, dim: int = DIM, seed: int = 5, scale: float = SCALE, rate: float = RATE) -> Model:
    """n-grams of fewer than MIN_DOCS texts (of 1 in 100 in a small sample) keep a vector of zeros: they tell nothing but the texts they are in."""
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    data = LOWER[data]
    starts, ends, wo = words(data, offs, WORD)
    n_docs = len(texts)
    _, first, at = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
    bins, bo = _subwords(data, starts[first], ends[first])
    n_sub = np.diff(bo)
    doc = np.repeat(np.arange(n_docs), np.diff(wo))
    pair = np.unique(doc * np.int64(len(first)) + at)
    doc, word = pair // len(first), pair % len(first)
    weight = (1 / (BLANKS + np.bincount(doc, minlength=n_docs)))[doc].astype(np.float32)

    in_docs = np.bincount(word, minlength=len(first))  # an upper bound for each word's n-grams together
    used, slot = np.unique(bins, return_inverse=True)
    word_of = np.repeat(np.arange(len(first)), n_sub)
    often = np.bincount(slot, in_docs[word_of]) >= max(2, min(MIN_DOCS, n_docs // 100))
    keep = often[slot]
    used, slot, word_of = used[often], (np.cumsum(often) - 1)[slot[keep]], word_of[keep]
    by_bin = np.argsort(slot, kind="stable")
    s_first = np.searchsorted(word_of, np.arange(len(first) + 1))
    b_first, by_bin = np.searchsorted(slot[by_bin], np.arange(len(used))), word_of[by_bin].astype(np.int32)
    slot = slot.astype(np.int32)
    some_word = np.flatnonzero(np.diff(s_first))
    held = np.diff(s_first)[word] > 0
    doc, word, weight = doc[held], word[held], weight[held]
    by_word = np.argsort(word, kind="stable")
    w_doc, w_weight, w_first = doc[by_word], weight[by_word], np.searchsorted(word[by_word], some_word)
    some_doc, d_first = np.unique(doc, return_index=True)
    per = 1 / n_sub.astype(np.float32)[some_word]

    # One dimension after the other: sums over runs of a flat array are much faster than over rows of a few numbers.
    g = np.random.default_rng(seed)
    p = {"e": np.ascontiguousarray((g.standard_normal((len(used), dim)) * 0.1).astype(np.float32).T), "w": (g.standard_normal((dim, 2)) * 0.5).astype(np.float32), "b": np.zeros(2, np.float32)}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    y = np.eye(2, dtype=np.float32)[np.array(labels)]
    wv, dwv, h, de = (np.zeros((dim, n), np.float32) for n in (len(first), len(first), n_docs, len(used)))
    for step in range(1, steps + 1):
        for d in range(dim):
            wv[d, some_word] = np.add.reduceat(p["e"][d][slot], s_first[some_word]) * per
            h[d, some_doc] = np.add.reduceat(weight * wv[d][word], d_first)
        z = h.T @ p["w"] * scale + p["b"]
        z = np.exp(z - z.max(1, keepdims=True))
        dz = (z / z.sum(1, keepdims=True) - y) / n_docs
        dh = p["w"] @ dz.T * scale
        for d in range(dim):
            dwv[d, some_word] = np.add.reduceat(w_weight * dh[d][w_doc], w_first) * per
            de[d] = np.add.reduceat(dwv[d][by_bin], b_first)
        grad = {"w": h @ dz * scale, "b": dz.sum(0), "e": de}
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, x in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            size = np.sqrt(v[k] / (1 - 0.99**step))
            p[k] = p[k] - lr * (m[k] / (1 - 0.9**step)) / (size + FLOOR * size.max() + 1e-12)
    odds = np.zeros(1 << BITS, np.float32)
    odds[used] = (p["w"][:, 1] - p["w"][:, 0]) @ p["e"] * scale
    return Model(odds, float(p["b"][1] - p["b"][0]))


def train(docs: DataFrame, labels: DataFrame, docs_per_class: dict[int, int] = DOCS_PER_CLASS) -> Model | None:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1; others are left out)."""
    spark = docs.sparkSession
    small_batches(spark)
    labels = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("toxic") == 1, docs_per_class[1] / sizes[1]).otherwise(docs_per_class[0] / sizes[0])
    sample = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) / float(1 << 20) < share)
    sample = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # some 3,800 ids

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "toxic"])
        return pd.DataFrame({"model": [pickle.dumps(fit(pdf["text"].tolist(), pdf["toxic"].tolist()) if pdf["toxic"].nunique() == 2 else None)]})

    row = sample.groupBy(F.lit(0).alias("g")).applyInPandas(run, "model binary").first()
    return pickle.loads(row["model"]) if row else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with tox_score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [c for c in docs.columns if c != "tox_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.score(*text_buffers(batch.column("text"))) if shared.value else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(got, pa.float64())], [*cols, "tox_score"])

    docs = docs.select(*cols)
    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias("tox_score")).schema)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"))
