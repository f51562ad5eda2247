"""Suffix-array dedup: bytes covered by DEPTH-byte strings that start more than once, by merging Burrows-Wheeler transforms.

How it is spread over a cluster, exactly:

1. Every DEPTH-byte window of a text has a minimizer, the K-byte string in it whose hash is least (the leftmost of
   equals); equal windows have equal minimizers. Consecutive windows with one minimizer make a stretch of text. Stretches
   travel as packed rows without their bytes: document, start, number of windows, hashes of minimizer and bytes.
2. By bucket of minimizer hashes: minimizers found once are dropped, stretches of equal bytes become one class. All
   windows of a class with two stretches or more are repeated. Where a minimizer has two classes or more, the bytes of one
   stretch of each are asked for.
3. Those are cut from the texts and sent to the bucket, which makes Burrows-Wheeler transforms of shards of them and
   merges the shards by iterative interleave refinement to depth DEPTH; blocks of two or more suffixes are the repeated
   windows. Since equal windows have equal minimizers, no other bucket holds any.
4. The bytes that repeated windows cover go back to their documents.

A minimizer that more than one in HOT of all stretches have is passed over when minimizers are chosen again, if a window
has another, so that a line that very many texts hold doesn't send them all to one bucket; there are fewer than HOT such.

Edge cases: a null text is empty; texts under DEPTH bytes lose nothing; rows that agree in doc_id and text are copies of
each other; windows never cross documents; overlapping and touching windows make one removed run; an empty table gives
no rows; other columns pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import repeated
from .common import CHUNK_BYTES, Scratch, chunks, one_row, packed, row_key, shield, small_batches, table, text_buffers, unpacked
from .textnp import mix, prefix_hash, span_hash

DEPTH = 200
K = 32
BUCKET_BYTES = 4 << 20
BLOCK_STRETCHES = 1 << 17
SHARD_BYTES = 1 << 17
MERGE_BYTES = 1 << 19  # merged at once, if a minimizer's stretches don't hold more
HOT = 2000
HOT_LEAST = 2000
_ORDER = np.uint64(0x9E3779B97F4A7C15)
_AT = 28  # bits of a position in a sliding minimum


def stretches(data: np.ndarray, offs: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, minimizer hash and hash of the bytes of each stretch of the texts."""
    none = np.zeros(0, np.int64)
    m = len(data) - K + 1
    if len(data) < DEPTH:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    c = prefix_hash(data)
    at = np.arange(m)
    h = span_hash(c, at, at + K)
    with np.errstate(over="ignore"):
        v = (h * _ORDER) >> np.uint64(_AT)  # not by h itself, or least hashes would all fall into the first buckets
    if hot is not None and len(hot):
        late = np.isin(h, hot)
        v = (v >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63 - _AT))
    v = (v << np.uint64(_AT)) | at.astype(np.uint64)
    w = DEPTH - K + 1
    pad = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:m] = v
    pad = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - DEPTH + 1
    best = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64((1 << _AT) - 1)).astype(np.int64)
    left = np.repeat(offs[1:], np.diff(offs))[:n] - np.arange(n)  # bytes of the text from here on
    ok = left >= DEPTH
    new = np.r_[True, (best[1:] != best[:-1]) | ~ok[:-1]] & ok
    last = np.r_[(best[1:] != best[:-1]) | ~ok[1:], True] & ok
    start, end = np.flatnonzero(new), np.flatnonzero(last) + 1
    return start, end - start, h[best[start]], mix(span_hash(c, start, end + DEPTH - 1) ^ h[best[start]])


def _pieces(offs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """First and last row and byte range of pieces of the texts; a long text is cut into several, overlapping by DEPTH - 1."""
    for i, j in chunks(offs):
        if j - i > 1 or offs[j] - offs[i] <= 2 * CHUNK_BYTES:
            yield i, j, int(offs[i]), int(offs[j])
        else:
            for a in range(int(offs[i]), int(offs[j]), CHUNK_BYTES):
                if a == offs[i] or offs[j] - a >= DEPTH:
                    yield i, j, a, int(min(a + CHUNK_BYTES + DEPTH - 1, offs[j]))


def _messages(docs: DataFrame, n_buckets: int, hot: np.ndarray | None = None) -> DataFrame:
    """docs: k, text. Packed rows of stretches by bucket: ks (documents), of (which), start, n, sig, cls; in rows of bucket -1, ks, start and sig are documents and byte ranges that a block knows to be repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def pack(parts: list[tuple]) -> pa.RecordBatch:
        ks, of, start, n, sig, cls = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((cls, sig))
        of, start, n, sig, cls = (x[order] for x in (of, start, n, sig, cls))
        new = np.flatnonzero(np.r_[True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])]) if len(sig) else np.zeros(0, int)
        sent = np.arange(len(sig)) - np.repeat(new, np.diff(np.r_[new, len(sig)])) < 2
        known = [one_row(x) for x in (ks[of[~sent]], np.zeros(0, "<u4"), start[~sent], np.zeros(0, "<u2"), (start + n + DEPTH - 1)[~sent], np.zeros(0, "<u8"))]
        of, start, n, sig, cls = (x[sent] for x in (of, start, n, sig, cls))
        to = (sig >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
        cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else np.zeros(1, np.int64)
        row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        held, at = np.unique(row * np.int64(len(ks) + 1) + of, return_inverse=True)
        held_cuts = np.searchsorted(held, np.arange(len(cuts)) * np.int64(len(ks) + 1))
        cols = [packed(ks[held % np.int64(len(ks) + 1)], held_cuts), *(packed(x, cuts) for x in ((at - held_cuts[row]).astype("<u4"), start.astype("<i8"), n.astype("<u2"), sig, cls))]
        return pa.RecordBatch.from_arrays([pa.array(np.r_[to[cuts[:-1]].astype(np.int64), -1], pa.int32()), *(pa.concat_arrays(x) for x in zip(cols, known, strict=True))], ["bucket", "ks", "of", "start", "n", "sig", "cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, rows = [], 0, 0
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            k = batch.column("k").to_numpy(zero_copy_only=False)
            for i, j, a, z in _pieces(offs):
                local = np.clip(offs[i : j + 1], a, z) - a
                start, n, sig, cls = stretches(data[a:z], local, shared.value)
                doc = np.searchsorted(local, start, "right") - 1
                parts.append((k[i:j], doc + rows, start - local[doc] + (a - offs[i] if j - i == 1 else 0), n, sig, cls))
                size, rows = size + len(start), rows + j - i
                if size >= BLOCK_STRETCHES:
                    yield pack(parts)
                    parts, size, rows = [], 0, 0
        if parts:
            yield pack(parts)

    return docs.mapInArrow(run, "bucket int, ks binary, of binary, start binary, n binary, sig binary, cls binary")


def _unpack(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """k, start, n, sig, cls of all stretches of a bucket, by sig and cls."""
    ks, cuts = unpacked(rows.column("ks"), "<i8")
    of, of_cuts = unpacked(rows.column("of"), "<u4")
    ks = ks[of + np.repeat(cuts[:-1], np.diff(of_cuts))]
    start, n, sig, cls = (unpacked(rows.column(c), t)[0] for c, t in (("start", "<i8"), ("n", "<u2"), ("sig", "<u8"), ("cls", "<u8")))
    order = np.lexsort((start, ks, cls, sig))
    return ks[order], start[order], n[order].astype(np.int64), sig[order], cls[order]


def _by_document(ks: np.ndarray, *cols: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The documents, and a packed row of each column for each."""
    order = np.argsort(ks, kind="stable")
    ks = ks[order]
    cuts = np.flatnonzero(np.r_[True, ks[1:] != ks[:-1], True]) if len(ks) else np.zeros(1, int)
    return ks[cuts[:-1]], [packed(c[order].astype("<i8"), cuts) for c in cols]


PICKED = "kind int, bucket int, k long, a binary, b binary, c binary, d binary, e binary"


def _picked(kind: int, bucket: int, ks: np.ndarray, cols: list[pa.Array]) -> pa.Table:
    n = len(ks)
    cols = [*cols, *(pa.nulls(n, pa.binary()) for _ in range(5 - len(cols)))]
    return pa.table([pa.array([kind] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(ks, pa.int64()), *cols], names=["kind", "bucket", "k", *"abcde"])


def _pick(rows: pa.Table) -> pa.Table:
    """kind 0: the bucket's stretches of minimizers found twice or more; kind 1: by document, what to cut out of it."""
    bucket = rows.column("bucket")[0].as_py()
    ks, start, n, sig, cls = _unpack(rows)
    first = np.r_[True, sig[1:] != sig[:-1]]
    size = np.diff(np.r_[np.flatnonzero(first), len(sig)])
    keep = np.repeat(size > 1, size)
    ks, start, n, sig, cls = ks[keep], start[keep], n[keep], sig[keep], cls[keep]
    if not len(ks):
        return _picked(0, bucket, ks, [])
    new_cls = np.r_[True, (cls[1:] != cls[:-1]) | (sig[1:] != sig[:-1])]
    at = np.cumsum(new_cls) - 1
    rep = np.flatnonzero(new_cls)
    of_sig = (np.cumsum(np.r_[True, sig[1:] != sig[:-1]]) - 1)[rep]
    own = _picked(0, bucket, np.zeros(1, np.int64), [one_row(x.astype("<i8")) for x in (ks, start, n, at, of_sig)])
    rep = rep[np.bincount(of_sig)[of_sig] > 1]
    return pa.concat_tables([own, _picked(1, bucket, *_by_document(ks[rep], start[rep], n[rep], at[rep]))])


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 2: by document, the byte ranges that the blocks know to be repeated."""
    for batch in batches:
        ks, lo, hi = (unpacked(batch.column(c), "<i8")[0] for c in ("ks", "start", "sig"))
        yield from _picked(2, -1, *_by_document(ks, lo, hi)).to_batches()


def _hot(rows: pa.Table) -> pa.Table:
    sig, count = np.unique(unpacked(rows.column("sig"), "<u8")[0], return_counts=True)
    many = count >= HOT_LEAST
    return pa.table([sig[many].view(np.int64), count[many], np.full(many.sum(), count.sum())], names=["sig", "n", "of"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each text, once, what the buckets want of it."""
    for batch in batches:
        raw, out = batch.column("text"), []
        for i, wanted in enumerate(batch.column("wanted").to_pylist()):
            data = memoryview(raw[i].as_buffer())
            for w in wanted:
                start, n = np.frombuffer(w["a"], "<i8"), np.frombuffer(w["b"], "<i8") + DEPTH - 1
                out.append((w["bucket"], w["c"], n.tobytes(), b"".join(data[s : s + m] for s, m in zip(start.tolist(), n.tolist(), strict=True))))
        for i in range(0, len(out), 1000):
            bucket, cls, lengths, data = zip(*out[i : i + 1000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *(pa.array(x, pa.binary()) for x in (cls, lengths, data))], ["bucket", "cls", "lengths", "data"])


def _solve(own: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    ks, start, n, at, of_sig = (np.concatenate([np.frombuffer(x, "<i8") for x in own[c]]) if len(own) else np.zeros(0, np.int64) for c in "abcde")
    cut: dict[int, bytes] = {}  # the bytes of each class; equal rows of documents give them again
    for cls, lens, data in zip(texts["cls"], texts["lengths"], texts["data"], strict=True):
        p = 0
        for c, m in zip(np.frombuffer(cls, "<i8").tolist(), np.frombuffer(lens, "<i8").tolist(), strict=True):
            cut[c] = data[p : p + m]
            p += m
    windows: dict[int, np.ndarray] = {}
    todo: list[int] = []
    size = 0

    def merge() -> None:
        shards, held = [], 0
        for c in todo:
            if not held:
                shards.append([])
            shards[-1].append(cut[c])
            held = held + len(cut[c]) if held + len(cut[c]) < SHARD_BYTES else 0
        packed = [(np.frombuffer(b"".join(x), np.uint8), np.array([len(y) for y in x])) for x in shards]
        which = iter(todo)
        for hit, (_, lens) in zip(repeated(packed, DEPTH), packed, strict=True):
            p = 0
            for m in lens.tolist():
                windows[next(which)] = np.flatnonzero(hit[p : p + m - DEPTH + 1])
                p += m

    # Only stretches of one minimizer can hold equal windows, so minimizers are merged in batches.
    before = None
    for c in sorted(cut):
        if size >= MERGE_BYTES and of_sig[c] != before:
            merge()
            todo, size = [], 0
        todo.append(c)
        size += len(cut[c])
        before = of_sig[c]
    if todo:
        merge()
    many = np.bincount(at) if len(at) else np.zeros(0, np.int64)
    lo, hi, kk = [], [], []
    for i, c in enumerate(at.tolist()):
        if many[c] > 1:
            kk.append(ks[i])
            lo.append(start[i])
            hi.append(start[i] + n[i] + DEPTH - 1)
        elif len(w := windows.get(c, ())):
            cuts = np.flatnonzero(np.r_[True, np.diff(w) > 1, True])
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                kk.append(ks[i])
                lo.append(start[i] + w[a])
                hi.append(start[i] + w[z - 1] + DEPTH)
    ks, cols = _by_document(np.array(kk, np.int64), np.array(lo, np.int64), np.array(hi, np.int64))
    return pd.DataFrame({"k": ks, "lo": cols[0].to_pylist(), "hi": cols[1].to_pylist()})


def removed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs: k, text. By k: spans, the byte ranges that repeated windows cover (lists of packed int64 lo and hi)."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(8, -(-size // BUCKET_BYTES))
    sent = scratch.cut(_messages(docs, n_buckets), "sent")
    hot = sent.filter("bucket >= 0").select("bucket", "sig").groupBy("bucket").applyInArrow(_hot, "sig long, n long, of long")
    # A minimizer that more than one in HOT stretches of a bucket's share times the buckets have: fewer than HOT of them.
    hot = [r["sig"] for r in hot.filter(F.col("n") * HOT > F.col("of") * n_buckets).select("sig").collect()]
    if hot:
        sent = scratch.cut(_messages(docs, n_buckets, np.sort(np.array(hot, np.int64).view(np.uint64))), "sent2")
        scratch.drop("sent")
    found = sent.filter("bucket >= 0").groupBy("bucket").applyInArrow(_pick, PICKED)
    picked = scratch.cut(found.union(sent.filter("bucket < 0").select("ks", "start", "sig").mapInArrow(_known, PICKED)), "picked")
    scratch.drop("sent2" if hot else "sent")
    wanted = picked.filter("kind = 1").groupBy("k").agg(F.collect_list(F.struct("bucket", "a", "b", "c")).alias("wanted"))
    texts = docs.join(wanted, "k").select("text", "wanted").mapInArrow(_cut, "bucket int, cls binary, lengths binary, data binary")
    own = picked.filter("kind = 0").select("bucket", "a", "b", "c", "d", "e")
    found = own.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInPandas(_solve, "k long, lo binary, hi binary")
    found = found.union(picked.filter("kind = 2").select("k", "a", "b"))
    return found.groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _runs(spans: list[dict] | None) -> np.ndarray:
    """Maximal removed runs as rows of start and end."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    lo, hi = (np.concatenate([np.frombuffer(s[c], "<i8") for s in spans]) for c in ("lo", "hi"))
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > hi[:-1]]
    return np.stack([lo[new], hi[np.r_[np.flatnonzero(new)[1:] - 1, len(hi) - 1]]], 1)


def dedup(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with removed: the maximal runs of bytes to remove, packed int64 pairs."""
    docs, back = shield(docs, "doc_id", "text")
    cols = docs.columns
    found = removed(docs.select(row_key().alias("k"), "text"), scratch).select(F.col("k").alias("_k"), F.col("spans").alias("_spans"))
    joined = docs.withColumn("_k", row_key()).join(found, "_k", "left").select(*cols, "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_runs(s).astype("<i8").tobytes() for s in batch.column("_spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(out, pa.binary())], [*cols, "removed"])

    return back(joined.mapInArrow(run, docs.withColumn("removed", F.lit(b"")).schema), "removed")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            n_removed, n_spans, sha = [], [], []
            for i, raw in enumerate(batch.column("removed").to_pylist()):
                own, runs = memoryview(data[offs[i] : offs[i + 1]]), np.frombuffer(raw, "<i8").reshape(-1, 2)
                digest, at = hashlib.sha256(), 0
                for a, b in runs.tolist():
                    digest.update(own[at:a])
                    at = b
                digest.update(own[at:])
                n_removed.append(int((runs[:, 1] - runs[:, 0]).sum()))
                n_spans.append(len(runs))
                sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offs)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


OP8_SQL = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
r AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w SEMI JOIN r USING (m)),
g AS (SELECT doc_id, i, sum(CASE WHEN i - p <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
t AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY doc_id, run),
k AS (
  SELECT doc_id, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS kept, max(z) AS z, sum(z - a) AS n_removed, count(*) AS n_spans
  FROM (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM t) JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
