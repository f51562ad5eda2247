"""Masked pseudo-likelihood: a bidirectional window network predicts every word of a text from both sides.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. The SIDE words on either side of the masked one are embedded,
joined and put through a tanh layer, from which two softmaxes choose the masked word's unit: first one of GROUPS groups,
then one of the group's MEMBERS. The OWN most frequent words are units of their own; any other word belongs to the unit
of its ending (a hash of its last ENDING bytes, with a bound where it is shorter), which tells languages and word forms
apart and is also known of words that the corpus doesn't hold. Within its unit a word has its share of the unit's
occurrences: P(word | both sides) = P(unit | both sides) * count / count of the unit. A text's score is the sum of its
words' log-probabilities. So the vocabulary, all distinct words (by 64-bit hash) with their exact counts, grows with the
corpus, in buckets of the hash spread over the cluster, while the network's size is constant. Over the words of the
corpus the probabilities add up to 1; a word that isn't in the corpus counts as half an occurrence of its unit.

How it runs:

1. Documents are dealt into shards of about SHARD_BYTES by a hash of the row, and ordered by it. A shard is tokenised
   once: its sorted distinct hashes with counts, each word's place among them, and each distinct word's ending.
2. Distinct hashes and counts go to their buckets, which add them up and send the sums back to each shard.
3. The shard turns words into units, and keeps two bytes a word and each text's sum of log counts. Everything after
   this reads that table, not the texts.
4. Training starts from the units' own frequencies. In each of ROUNDS rounds every shard starts from the common network
   and takes one Adagrad pass over every word; the shards' networks are averaged, weighted by words. A task sums its
   shards' networks, and networks are summed in groups of FAN rows, packed by block, so no task holds more than FAN.

Shards follow from the rows alone, so the network and the scores don't depend on how the table is partitioned (but for
the rounding of sums). The driver gets the sums, at most OWN words and the number of words of each count.

Edge cases: a null, empty or word-free text has n_tokens 0 and scores of 0; a corpus without words leaves the network as
it starts; rows are scored one by one, so repeated rows agree; a text longer than SHARD_BYTES is a shard of its own size,
held and trained whole by one task; an empty table gives no rows; columns named n_tokens, logprob or mean_logprob are
replaced, other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, one_row, packed, row_key, small_batches, table, text_buffers, unpacked
from .textnp import LOWER, SPACE, prefix_hash, span_hash, words

SIDE = 2
DIM, HIDDEN = 8, 24
GROUPS, MEMBERS = 64, 64
UNITS = GROUPS * MEMBERS
OWN = 1024
ENDING = 3
ROUNDS = 2
BATCH = 4096
RATE = 0.2
SHARD_BYTES = 4 << 20
SHARDS_A_BUCKET = 4
BLOCKS, FAN = 8, 64
_OFFSETS = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash and the ending of each word, and each text's offset into them."""
    data = LOWER[data]
    starts, ends, wo = words(data, offs, ~SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), wo
    c = prefix_hash(data)
    short = ends - starts < ENDING
    last = span_hash(c, np.where(short, starts, ends - ENDING), ends) + short
    return span_hash(c, starts, ends), (last % np.uint64(UNITS - OWN)).astype(np.uint16), wo


def _ending_unit(ending: np.ndarray) -> np.ndarray:
    return ending % GROUPS * MEMBERS + OWN // GROUPS + ending // GROUPS


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    """The bucket, of n, of each hash; ascending for ascending hashes."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _cuts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.r_[0, np.flatnonzero(x[1:] != x[:-1]) + 1, len(x)] if len(x) else np.zeros(1, np.int64)


def _planes(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower two bytes of numbers, and the rest in one byte where that is enough."""
    return at.astype("<u2"), (at >> 16).astype("u1" if at.max(initial=0) < 1 << 24 else "<u4")


def _joined(low: np.ndarray, high: bytes) -> np.ndarray:
    return low + (np.frombuffer(high, "u1" if len(high) == len(low) else "<u4").astype(np.int64) << 16)


# -- counting


def _n_shards(docs: DataFrame) -> int:
    return max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))


def _tokenised(docs: DataFrame, n: int, cols: list[str]) -> DataFrame:
    """A row for each shard: its rows' columns `cols`, word offsets, distinct hashes with counts and endings, and each word's place among them."""
    key = row_key() if "doc_id" in docs.columns else F.xxhash64("text")
    dealt = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)), F.col("text").alias("t"), key.alias("key"))
    dealt = dealt.withColumn("shard", F.pmod("key", F.lit(n)))

    def encode(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("key").to_numpy(), kind="stable"))).combine_chunks()
        h, ending, wo = tokens(*text_buffers(rows.column("t")))
        h, first, at, c = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        sink = pa.BufferOutputStream()
        kept = rows.select([f"c{i}" for i in range(len(cols))])
        with pa.ipc.new_stream(sink, kept.schema) as w:
            w.write_table(kept)
        own = [pa.array([sink.getvalue().to_pybytes()], pa.binary()), *map(one_row, (wo, h, c, ending[first], *_planes(at)))]
        return pa.table([rows.column("shard")[:1], *own], names=["shard", "kept", "wo", "h", "c", "ending", "low", "high"])

    return dealt.groupBy("shard").applyInArrow(encode, "shard long, kept binary, wo binary, h binary, c binary, ending binary, low binary, high binary")


def _asked(shards: DataFrame, n: int) -> DataFrame:
    """The shards' distinct hashes and counts, a row for each bucket that has some."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, shard in enumerate(batch.column("shard").to_pylist()):
                h, c = (unpacked(batch.column(k).slice(i, 1), t)[0] for k, t in (("h", "<u8"), ("c", "<i8")))
                b = _buckets(h, n)
                cuts = _cuts(b)
                yield pa.RecordBatch.from_arrays([pa.array(b[cuts[:-1]]), pa.array(np.full(len(cuts) - 1, shard)), packed(h, cuts), packed(c, cuts)], ["bucket", "shard", "h", "c"])

    return shards.select("shard", "h", "c").mapInArrow(deal, "bucket int, shard long, h binary, c binary")


def _answers(asked: pa.Table, h: np.ndarray, own: np.ndarray, c: np.ndarray) -> pa.Table:
    """The counts (c, of the hashes `own`) of what each row asks for."""
    q, cuts = (h, unpacked(asked.column("h"), "<u8")[1]) if h is not None else unpacked(asked.column("h"), "<u8")
    got = np.zeros(len(q), np.int64)
    if len(own):
        at = np.minimum(np.searchsorted(own, q), len(own) - 1)
        got = np.where(own[at] == q, c[at], 0)
    return pa.table([asked.column("bucket"), asked.column("shard"), packed(got.astype("<i8"), cuts)], names=["bucket", "shard", "c"])


ANSWER = "bucket int, shard long, h binary, c binary"


def _counted(asked: DataFrame) -> DataFrame:
    """Rows of shard -1 are the vocabulary: a bucket's sorted hashes and their counts. The others are answers to shards."""

    def add(rows: pa.Table) -> pa.Table:
        h, c = unpacked(rows.column("h"), "<u8")[0], unpacked(rows.column("c"), "<i8")[0]
        order = np.argsort(h, kind="stable")
        first = _cuts(h[order])[:-1]
        own, total = h[order][first], np.add.reduceat(c[order], first)
        got = _answers(rows, h, own, total)
        vocab = pa.table([rows.column("bucket")[:1], pa.array([-1], pa.int64()), one_row(own), one_row(total)], names=["bucket", "shard", "h", "c"])
        return pa.concat_tables([vocab, pa.table([got.column("bucket"), got.column("shard"), pa.nulls(len(got), pa.binary()), got.column("c")], names=["bucket", "shard", "h", "c"])])

    return asked.groupBy("bucket").applyInArrow(add, ANSWER)


def _looked_up(asked: DataFrame, vocab: DataFrame) -> DataFrame:
    """Answers to shards from a vocabulary."""

    def answer(own: pa.Table, rows: pa.Table) -> pa.Table:
        return _answers(rows, None, unpacked(own.column("h"), "<u8")[0], unpacked(own.column("c"), "<i8")[0])

    found = vocab.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, "bucket int, shard long, c binary")
    return found.select("bucket", "shard", "c")


def _own_words(vocab: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words, OWN at most, most frequent first: those of the highest counts that fit together."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, n = np.unique(unpacked(batch.column("c"), "<i8")[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], ["c", "n"])

    by_count = vocab.select("c").mapInArrow(sizes, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("c")).limit(OWN).collect()
    n, least = 0, None
    for r in by_count:
        n += r["n"]
        if n > OWN:
            break
        least = r["c"]
    if least is None:
        return np.zeros(0, np.uint64)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c = unpacked(batch.column("h"), "<i8")[0], unpacked(batch.column("c"), "<i8")[0]
            yield pa.RecordBatch.from_arrays([pa.array(h[c >= least]), pa.array(c[c >= least])], ["h", "c"])

    rows = vocab.select("h", "c").mapInArrow(frequent, "h long, c long").orderBy(F.desc("c"), "h").collect()
    return np.array([r["h"] for r in rows], np.int64).view(np.uint64)


def _tasks(spark: SparkSession, n_shards: int) -> int:
    """Shards are little data and much work: one for each task up to twice the cores, then up to 8."""
    return max(1, min(n_shards, max(2 * spark.sparkContext.defaultParallelism, -(-n_shards // 8))))


def _coded(shards: DataFrame, answers: DataFrame, own: np.ndarray, n: int) -> DataFrame:
    """A row for each shard: the columns kept, word offsets, each word's unit, each text's sum of log counts, and the words of each unit."""
    by_hash = np.argsort(own)
    sorted_own, own_unit = own[by_hash], (by_hash % GROUPS * MEMBERS + by_hash // GROUPS).astype(np.int64)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct word's unit takes the place of its hash and ending before the shuffle."""
        for batch in batches:
            h, cuts = unpacked(batch.column("h"), "<u8")
            unit = _ending_unit(unpacked(batch.column("ending"), "<u2")[0].astype(np.int64))
            if len(sorted_own) and len(h):
                i = np.minimum(np.searchsorted(sorted_own, h), len(sorted_own) - 1)
                unit = np.where(sorted_own[i] == h, own_unit[i], unit)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("shard", "kept", "wo", "low", "high")), packed(unit.astype("<u2"), cuts)], ["shard", "kept", "wo", "low", "high", "unit"])

    def code(rows: pa.Table, got: pa.Table) -> pa.Table:
        got = got.sort_by("bucket")
        unit, wo, low = (unpacked(rows.column(k), t)[0] for k, t in (("unit", "<u2"), ("wo", "<i8"), ("low", "<u2")))
        at, c = _joined(low, rows.column("high")[0].as_py()), unpacked(got.column("c"), "<i8")[0]
        total = np.r_[0.0, np.cumsum(np.log(np.maximum(c, 0.5))[at])]
        return pa.table([rows.column("shard"), rows.column("kept"), rows.column("wo"), *map(one_row, (unit[at], total[wo[1:]] - total[wo[:-1]]))], names=["shard", "kept", "wo", "unit", "log_counts"])

    named = shards.mapInArrow(name, "shard long, kept binary, wo binary, low binary, high binary, unit binary")
    named, answers = named.repartition(n, "shard"), answers.repartition(n, "shard")
    return named.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(code, "shard long, kept binary, wo binary, unit binary, log_counts binary")


def _mass(coded: DataFrame) -> np.ndarray:
    """The words of the corpus in each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(UNITS, np.int64)
        for batch in batches:
            total += np.bincount(unpacked(batch.column("unit"), "<u2")[0], minlength=UNITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["unit", "n"])

    mass = np.zeros(UNITS)
    for r in coded.select("unit").mapInArrow(run, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n")).collect():
        mass[r["unit"]] = r["n"]
    return mass


# -- the network


def _exp(z: np.ndarray) -> np.ndarray:
    """In place; the bound keeps sums finite and above 0."""
    np.clip(z, -60, 60, out=z)
    return np.exp(z, out=z)


class Network:
    """Parameters: e, embeddings of units (the last: beyond a text's bounds); w, b, the tanh layer; a, the choice of a group; o, that of a member.

    The last rows of a and of each group's o are biases: the tanh layer's last output is always 1.
    """

    def __init__(self, mass: np.ndarray | None = None, seed: int = 1) -> None:
        g = np.random.default_rng(seed)
        share = np.full((GROUPS, MEMBERS), 1 / UNITS) if mass is None else ((mass + 0.5) / (mass + 0.5).sum()).reshape(GROUPS, MEMBERS)
        inputs = 2 * SIDE * DIM
        self.p = {
            "e": (g.standard_normal((UNITS + 1, DIM)) * 0.3).astype(np.float32),
            "w": (g.standard_normal((inputs, HIDDEN)) / np.sqrt(inputs)).astype(np.float32),
            "b": np.zeros(HIDDEN, np.float32),
            "a": np.zeros((HIDDEN + 1, GROUPS), np.float32),
            "o": np.zeros((GROUPS, HIDDEN + 1, MEMBERS), np.float32),
        }
        self.p["a"][-1] = np.log(share.sum(1))
        self.p["o"][:, -1] = np.log(share / share.sum(1, keepdims=True))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self

    def _forward(self, ctx: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """ctx, y sorted by group of y: the input, the tanh layer, e to the logits of groups and of members, their sums, and where each group's words begin."""
        p, n = self.p, len(y)
        x = p["e"][ctx].reshape(n, -1)
        h = np.ones((n, HIDDEN + 1), x.dtype)
        np.tanh(x @ p["w"] + p["b"], out=h[:, :-1])
        first = _exp(h @ p["a"])
        cuts = np.searchsorted(y, np.arange(GROUPS + 1) * MEMBERS)
        second = np.empty((n, MEMBERS), x.dtype)
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            i, j = cuts[g], cuts[g + 1]
            np.matmul(h[i:j], p["o"][g], out=second[i:j])
        _exp(second)
        return x, h, first, second, first @ np.ones(GROUPS, x.dtype), second @ np.ones(MEMBERS, x.dtype), cuts

    def log_probs(self, ctx: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the units y between their contexts."""
        order = np.argsort(y.astype(np.uint16), kind="stable")
        y, at = y[order], np.arange(len(y))
        _, _, first, second, sum1, sum2, _ = self._forward(ctx[order], y)
        out = np.empty(len(y))
        out[order] = np.log(first[at, y // MEMBERS] / sum1) + np.log(second[at, y % MEMBERS] / sum2)
        return out

    def step(self, ctx: np.ndarray, y: np.ndarray, seen: dict[str, np.ndarray]) -> None:
        """One Adagrad step for a batch; seen: the sums of squared gradients."""
        order = np.argsort(y.astype(np.uint16), kind="stable")
        ctx, y, at = ctx[order], y[order], np.arange(len(y))
        p, n = self.p, len(y)
        x, h, first, second, sum1, sum2, cuts = self._forward(ctx, y)
        for z, total, target in ((first, sum1, y // MEMBERS), (second, sum2, y % MEMBERS)):
            z *= (1 / (n * total))[:, None]
            z[at, target] -= 1 / n
        grad = {"a": h.T @ first, "o": np.zeros_like(p["o"])}
        dh, more = first @ p["a"].T, np.empty_like(h)
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            i, j = cuts[g], cuts[g + 1]
            np.matmul(h[i:j].T, second[i:j], out=grad["o"][g])
            np.matmul(second[i:j], p["o"][g].T, out=more[i:j])
        dh += more
        dh *= 1 - h * h  # 0 for the constant
        dh = dh[:, :-1]
        grad["w"], grad["b"] = x.T @ dh, dh.sum(0)
        dx = (p["w"] @ dh.T).reshape(2 * SIDE, DIM, n)
        rows = ctx.T.ravel()
        grad["e"] = np.stack([np.bincount(rows, dx[:, d].ravel(), UNITS + 1) for d in range(DIM)], 1).astype(x.dtype)
        for k, d in grad.items():
            seen[k] += d * d
            size = np.sqrt(seen[k])
            size += 1e-6
            d /= size
            d *= RATE
            p[k] -= d


def _padded(units: np.ndarray, wo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units with SIDE bounds (UNITS) before and after every text, and each word's place among them."""
    at = np.arange(len(units)) + SIDE * (np.repeat(np.arange(len(wo) - 1), np.diff(wo)) + 1)
    out = np.full(len(units) + SIDE * len(wo), UNITS, np.int64)
    out[at] = units
    return out, at


def _tree_sum(parts: DataFrame, n: int) -> np.ndarray:
    """parts: at (row), block, x (float64s); the sum of each block over n rows, joined."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        total = np.frombuffer(pdf["x"].iloc[0], "<f8").copy()
        for x in pdf["x"].iloc[1:]:
            total += np.frombuffer(x, "<f8")
        return pd.DataFrame({"at": [pdf["at"].min()], "block": [pdf["block"].iloc[0]], "x": [total.tobytes()]})

    while True:
        n = -(-n // FAN)
        parts = parts.selectExpr(f"CAST(at % {n} AS INT) AS at", "block", "x").groupBy("at", "block").applyInPandas(add, "at int, block int, x binary")
        if n == 1:
            rows = sorted(parts.collect(), key=lambda r: r["block"])
            return np.concatenate([np.frombuffer(r["x"], "<f8") for r in rows]) if rows else np.zeros(0)


def _fit(coded: DataFrame, net: Network, rounds: int) -> Network:
    spark = coded.sparkSession
    texts = coded.select("wo", "unit")
    n = max(1, texts.rdd.getNumPartitions())
    for r in range(rounds):
        start = spark.sparkContext.broadcast(net.flat())

        def learn(batches: Iterator[pa.RecordBatch], r: int = r, start=start) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            total = np.zeros(len(start.value) + 1)
            for batch in batches:
                for i in range(batch.num_rows):
                    wo, units = (unpacked(batch.column(k).slice(i, 1), t)[0] for k, t in (("wo", "<i8"), ("unit", "<u2")))
                    if not len(units):
                        continue
                    own = Network().load(start.value)
                    seen = {k: np.full_like(x, 1e-4) for k, x in own.p.items()}
                    row, place = _padded(units, wo)
                    place = np.random.default_rng(len(place) + r).permutation(place)
                    for a in range(0, len(place), BATCH):
                        part = place[a : a + BATCH]
                        own.step(row[part[:, None] + _OFFSETS], row[part], seen)
                    total[:-1] += own.flat().astype(np.float64) * len(units)
                    total[-1] += len(units)
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([at] * BLOCKS, pa.int32()), pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in np.array_split(total, BLOCKS)], pa.binary())], ["at", "block", "x"])

        got = _tree_sum(texts.mapInArrow(learn, "at int, block int, x binary"), n)
        if len(got) and got[-1]:
            net = Network().load(got[:-1] / got[-1])
        start.unpersist()
    return net


# -- the operator


@dataclass
class Model:
    """vocab: a scratch table of bucket, h and c; own: hashes of the words that are units; mass: the corpus's words of each unit."""

    vocab: DataFrame
    n_buckets: int
    own: np.ndarray
    mass: np.ndarray
    net: Network


NEW = ("n_tokens", "logprob", "mean_logprob")


def _scored(coded: DataFrame, model: Model, docs: DataFrame, cols: list[str]) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast((model.net, np.log(np.maximum(model.mass, 1.0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, log_mass = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                wo, units, log_counts = (unpacked(batch.column(k).slice(i, 1), t)[0] for k, t in (("wo", "<i8"), ("unit", "<u2"), ("log_counts", "<f8")))
                row, place = _padded(units, wo)
                lp = -log_mass[units]
                for a in range(0, len(place), 2 * BATCH):
                    part = place[a : a + 2 * BATCH]
                    lp[a : a + len(part)] += net.log_probs(row[part[:, None] + _OFFSETS], row[part])
                total = np.r_[0.0, np.cumsum(lp)]
                n, total = np.diff(wo), total[wo[1:]] - total[wo[:-1]] + log_counts
                kept = pa.ipc.open_stream(batch.column("kept")[i].as_buffer()).read_all()
                out = pa.table([*kept.columns, pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))], names=[*cols, *NEW])
                yield from out.to_batches(max_chunksize=1000)

    schema = docs.select(*(f"`{c}`" for c in cols)).selectExpr("*", "CAST(0 AS LONG) AS n_tokens", "CAST(0 AS DOUBLE) AS logprob", "CAST(0 AS DOUBLE) AS mean_logprob").schema
    return coded.select("kept", "wo", "unit", "log_counts").mapInArrow(run, schema)


def _learned(docs: DataFrame, cols: list[str], rounds: int, scratch: Scratch) -> tuple[Model, DataFrame]:
    """The model of a corpus, and the corpus as the model's units."""
    small_batches(docs.sparkSession)
    n_shards = _n_shards(docs)
    n = max(8, -(-n_shards // SHARDS_A_BUCKET))
    shards = scratch.cut(_tokenised(docs, n_shards, cols), "shards")
    counted = scratch.cut(_counted(_asked(shards, n)), "counted")
    vocab, answers = counted.filter("shard < 0").select("bucket", "h", "c"), counted.filter("shard >= 0").select("bucket", "shard", "c")
    own = _own_words(vocab)
    coded = scratch.cut(_coded(shards, answers, own, _tasks(docs.sparkSession, n_shards)), "coded")
    scratch.drop("shards")
    mass = _mass(coded)
    return Model(vocab, n, own, mass, _fit(coded, Network(mass), rounds)), coded


def train(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """From doc_id and text."""
    return _learned(docs.select("doc_id", "text"), [], rounds, Scratch(docs.sparkSession))[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_tokens, logprob (sum) and mean_logprob."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    cols = [c for c in docs.columns if c not in NEW]
    n_shards = _n_shards(docs)
    shards = scratch.cut(_tokenised(docs, n_shards, cols), "shards")
    coded = _coded(shards, _looked_up(_asked(shards, model.n_buckets), model.vocab), model.own, _tasks(docs.sparkSession, n_shards))
    return _scored(coded, model, docs, cols)


def score_corpus(docs: DataFrame, columns: list[str], rounds: int = ROUNDS) -> DataFrame:
    """`columns` of docs with the scores that a model of docs itself gives; its texts are read and tokenised only once."""
    model, coded = _learned(docs, columns, rounds, Scratch(docs.sparkSession))
    return _scored(coded, model, docs, columns)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
