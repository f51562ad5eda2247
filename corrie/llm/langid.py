"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of characters that aren't letters counts as one blank, and n-grams of 1 to 3 characters
that hold a letter are hashed to BINS bins. Training counts the bins of a bounded sample of labelled rows, at most about
`docs_per_lang` of each language, chosen by a hash of the doc_id. The matrix of log-probabilities (BINS x languages) is
broadcast; its size follows the number of languages only. Scoring sums the matrix rows of a text's n-grams over the whole
text. A text of more than BLOCK characters is read in pieces that carry the last codes on, so every n-gram of the whole
counts once and memory doesn't follow the length of a text.

Edge cases: a text that is null or has no letter is `und` with score 0; without training rows every text is `und`; ties
go to the language that sorts first; rows are scored one by one, so repeated rows agree; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, small_batches, table

BITS = 15
BINS = 1 << BITS
ORDERS = (1, 2, 3)
DOCS_PER_LANG = 2000
SMOOTH = 0.05
BLOCK = 1 << 19
UNKNOWN = "und"
_BLANK = np.zeros(1, np.uint32)


@cache
def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 0 for other characters than letters."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[x], x, 0)


def _hashed(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each n-gram of codes, by start, and whether it holds a letter."""
    m = max(0, len(x) - n + 1)
    h, some = np.full(m, n, np.uint32), np.zeros(m, bool)
    for j in range(n):
        h = (h ^ x[j : j + m]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        some |= x[j : j + m] != 0
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS), some


def _short(rows: list[int], texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the rows of whole texts that have n-grams with a letter, and the bins and offsets of these."""
    x = [_letter_codes(t) for t in texts]
    offs = np.cumsum([0, *(len(c) + 2 for c in x)])
    x = np.concatenate([part for c in x for part in (_BLANK, c, _BLANK)])
    keep = x != 0
    keep[1:] |= x[:-1] != 0  # the first of a run of others
    keep[offs[:-1]] = True
    offs = np.r_[0, np.cumsum(keep)][offs]
    x = x[keep]
    for n in ORDERS:
        bins, some = _hashed(x, n)
        for j in range(1, n):  # n-grams that run over the end of a text
            at = offs[1:] - j
            some[at[(at >= 0) & (at < len(some))]] = False
        at = np.flatnonzero(some)
        cuts = np.searchsorted(at, offs)
        own = np.flatnonzero(np.diff(cuts))
        if len(own):
            yield np.array(rows)[own], bins[at], np.r_[cuts[own], len(at)]


def _long(row: int, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of one text in pieces of BLOCK characters: exactly the n-grams of the whole, each once."""
    tail, blank, at = _BLANK, True, 0
    while at <= len(text):
        end = min(at + BLOCK, len(text))
        while at + BLOCK // 2 < end < len(text) and text[end - 1].isalpha():  # a word is lower-cased whole, if there is a gap
            end -= 1
        x = _letter_codes(text[at:end])
        keep = x != 0
        keep[1:] |= x[:-1] != 0
        if len(x):
            keep[0] |= not blank
            blank = x[-1] == 0
        x = x[keep]
        at = end
        if at == len(text):
            x, at = x if blank else np.r_[x, _BLANK], at + 1
        both = np.concatenate([tail, x])
        for n in ORDERS:
            bins, some = _hashed(both, n)
            some[: max(0, len(tail) - n + 1)] = False  # the last piece's
            if some.any():
                yield np.array([row]), bins[some], np.array([0, int(some.sum())])
        tail = both[-(max(ORDERS) - 1) :]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All n-grams that hold a letter, of some texts at a time: the texts' rows, the n-grams' bins, each text's offset into them and the end."""
    rows, size = [], 0
    for i, t in enumerate(texts):
        if len(t) > BLOCK:
            yield from _long(i, t)
            continue
        rows.append(i)
        size += len(t)
        if size >= BLOCK:
            yield from _short(rows, [texts[r] for r in rows])
            rows, size = [], 0
    if rows:
        yield from _short(rows, [texts[r] for r in rows])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, docs: list[int]) -> None:
        """counts: languages x BINS."""
        self.langs = langs
        p = counts + SMOOTH
        self.table = np.ascontiguousarray(np.log(p / p.sum(1, keepdims=True)).T.astype(np.float32)) if langs else None
        self.prior = np.log(np.array(docs, float) / max(1, sum(docs)))

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        texts = [t or "" for t in texts]
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for rows, bins, cuts in grams(texts):
            total[rows] += np.add.reduceat(self.table[bins], cuts[:-1], axis=0, dtype=np.float64)
            n[rows] += np.diff(cuts)
        total += self.prior
        best = total.argmax(1)
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], np.where(n > 0, p.max(1), 0.0)


def train(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """From doc_id, text, lang; rows without a text or a language are left out."""
    spark = labelled.sparkSession
    small_batches(spark)
    labelled = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(docs_per_lang / n)).otherwise(share)
    at = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.filter(at < share)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(BINS)
        for _, bins, _ in grams(pdf["text"].tolist()):
            c += np.bincount(bins, minlength=BINS)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "counts": [c.astype("<f4").tobytes()]})

    rows = sorted(sample.groupBy("lang").applyInPandas(count, "lang string, counts binary").collect())
    langs = [r["lang"] for r in rows]
    return Model(langs, np.array([np.frombuffer(r["counts"], "<f4") for r in rows], float), [sizes[x] for x in langs])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and lang_score (columns of such names are replaced)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*cols, "lang_pred", "lang_score"])
            give_back()

    docs = docs.select(*cols)
    return docs.mapInArrow(run, docs.limit(0).select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score")).schema)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
