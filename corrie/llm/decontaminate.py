"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams scanned over token windows.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is `n` consecutive words of an item; an
item of fewer words is one window. Hits are verified word by word against the item, so a hash collision marks nothing.

Edge cases: null or word-free texts have no words and no hits; items without words make no window; repeated rows are
handled row by row; an empty benchmark or document table gives unmarked documents or no rows; further columns pass.
The window set is broadcast only up to BROADCAST_WINDOWS windows, about 20 bytes each besides the items' words. A larger
benchmark is scanned in parts of that size, one pass over the documents after the other: each pass is written to the
scratch folder before the next part is built and broadcast, so the driver and a task hold one part at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, StringType

from .common import Scratch, chunks, shield, small_batches, table, text_buffers
from .textnp import ALNUM, LOWER, prefix_hash, span_hash, window_hash, words

WINDOW = 10
BROADCAST_WINDOWS = 1_000_000
_BITS = 22


class Windows:
    """Windows of benchmark items by length: their sorted hashes, the place of each one's words, and the items that hold it."""

    def __init__(self, items: list[tuple[object, str | None]], n: int = WINDOW) -> None:
        self.ids = [str(i) for i, _ in items]
        raw = [(text or "").encode() for _, text in items]
        self.data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        self.starts, self.ends, wo = words(self.data, np.cumsum([0, *map(len, raw)]), ALNUM)
        h = span_hash(prefix_hash(self.data), self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)
        found: dict[int, dict[tuple[int, bytes], tuple[int, set[int]]]] = {}
        for at, (a, b) in enumerate(zip(wo[:-1].tolist(), wo[1:].tolist(), strict=True)):
            if k := min(n, b - a):
                for i, x in enumerate(window_hash(h[a:b], k).tolist(), a):
                    found.setdefault(k, {}).setdefault((x, self.words(i, k)), (i, set()))[1].add(at)
        self.by_len: dict[int, tuple[np.ndarray, ...]] = {}
        for k, own in found.items():
            keys = sorted(own)
            held = [sorted(own[x][1]) for x in keys]
            flags = np.zeros(1 << _BITS, bool)
            hashes = np.array([x for x, _ in keys], np.uint64)
            flags[hashes >> np.uint64(64 - _BITS)] = True
            self.by_len[k] = hashes, np.array([own[x][0] for x in keys]), np.cumsum([0, *map(len, held)]), np.concatenate(held).astype(np.int32), np.packbits(flags)
        self._flags: dict[int, np.ndarray] = {}

    def words(self, i: int, k: int) -> bytes:
        """k words of the items from the i-th on."""
        return b" ".join(self.data[self.starts[j] : self.ends[j]].tobytes() for j in range(i, i + k))

    def flags(self, k: int) -> np.ndarray:
        if k not in self._flags:
            self._flags[k] = np.unpackbits(self.by_len[k][-1]).view(bool)
        return self._flags[k]

    def scan(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, set[int]]]:
        """Word starts and ends, the texts' offsets into them, hit words, and the items found in each text."""
        data = LOWER[data]
        starts, ends, wo = words(data, offs, ALNUM)
        hit = np.zeros(len(starts) + 1, np.int64)
        items: dict[int, set[int]] = {}
        if len(starts) and self.by_len:
            h = span_hash(prefix_hash(data), starts, ends)
            last = np.repeat(wo[1:], np.diff(wo))
            for k, (hashes, first, cuts, held, _) in self.by_len.items():
                x = window_hash(h, k)
                if not len(x):
                    continue
                at = np.flatnonzero(self.flags(k)[x >> np.uint64(64 - _BITS)])
                at = at[at + k <= last[at]]
                lo, hi = np.searchsorted(hashes, x[at], "left"), np.searchsorted(hashes, x[at], "right")
                some = hi > lo
                for i, a, b in zip(at[some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
                    raw = b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(i, i + k))
                    for w in range(a, b):
                        if self.words(int(first[w]), k) == raw:
                            hit[i] += 1
                            hit[i + k] -= 1
                            items.setdefault(int(np.searchsorted(wo, i, "right")) - 1, set()).update(held[cuts[w] : cuts[w + 1]].tolist())
        return starts, ends, wo, np.cumsum(hit[:-1]) > 0, items


def parts(benchmark: DataFrame, most: int = BROADCAST_WINDOWS) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark's items in parts of at most about `most` windows; one part of none, if there are no items."""
    items, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        items.append((row[0], row[1]))
        size += 1 + len(row[1] or "") // 2
        if size >= most:
            yield items
            items, size = [], 0
    yield items


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """docs with _n_words, _hits (word and byte bounds of hit runs, packed int64) and _items (ids found, as strings); columns of such names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    docs, scratch, before = docs.drop("_n_words", "_hits", "_items"), None, None
    for i, items in enumerate(parts(benchmark, most)):
        if i and not items:
            break
        if i:  # the pass before is written, and its part let go, before this one is built
            scratch = scratch or Scratch(spark)
            docs = scratch.cut(docs, f"pass{i}")
            before.unpersist()
            scratch.drop(f"pass{i - 1}")
        before = spark.sparkContext.broadcast(Windows(items, n))
        docs = _pass(docs, before)
    return docs


def _pass(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """One part's hits, added to those that docs has."""
    more = "_hits" in docs.columns
    cols = [c for c in docs.columns if c not in ("_n_words", "_hits", "_items")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            old_hits, old_items = (batch.column(c).to_pylist() if more else [None] * batch.num_rows for c in ("_hits", "_items"))
            n_words, out_hits, out_items = [], [], []
            for i, j in chunks(offs):
                local = offs[i : j + 1] - offs[i]
                starts, ends, wo, hit, items = shared.value.scan(data[offs[i] : offs[j]], local)
                n_words += np.diff(wo).tolist()
                for d in range(j - i):
                    a, b = int(wo[d]), int(wo[d + 1])
                    if old_hits[i + d]:
                        for x, y in np.frombuffer(old_hits[i + d], "<i8").reshape(-1, 4)[:, :2].tolist():
                            hit[a + x : a + y] = True
                    out_items.append(sorted({*(old_items[i + d] or ()), *(shared.value.ids[x] for x in items.get(d, ()))}))
                    if not out_items[-1]:
                        out_hits.append(b"")
                        continue
                    own = np.flatnonzero(hit[a:b]) + a
                    run_at = np.flatnonzero(np.r_[True, np.diff(own) > 1])
                    first, last = own[run_at], own[np.r_[run_at[1:] - 1, len(own) - 1]]
                    out_hits.append(np.stack([first - a, last + 1 - a, starts[first] - local[d], ends[last] - local[d]], 1).astype("<i8").tobytes())
            arrays = [batch.column(c) for c in cols]
            arrays += [pa.array(n_words, pa.int64()), pa.array(out_hits, pa.binary()), pa.array(out_items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, [*cols, "_n_words", "_hits", "_items"])

    schema = docs.select(*cols).schema.add("_n_words", "long").add("_hits", "binary").add("_items", ArrayType(StringType()))
    return docs.mapInArrow(run, schema)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, drop_share: float = 0.5) -> DataFrame:
    """docs without hit spans: a hit run's bytes go, and a text with `drop_share` or more of its words hit goes whole.

    Texts without a hit, null texts among them, stay as they are.
    """
    docs, back = shield(docs, "text")
    cols, schema = docs.columns, docs.schema
    found = hits(docs, benchmark, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, raw, n_words = batch.column("text").to_pylist(), batch.column("_hits").to_pylist(), batch.column("_n_words").to_pylist()
            keep = []
            for i, (text, spans, total) in enumerate(zip(texts, raw, n_words, strict=True)):
                keep.append(True)
                if spans:
                    s = np.frombuffer(spans, "<i8").reshape(-1, 4)
                    keep[-1] = (s[:, 1] - s[:, 0]).sum() < drop_share * total
                    data, parts, at = text.encode(), [], 0
                    for a, b in s[:, 2:].tolist():
                        parts.append(data[at:a])
                        at = b
                    texts[i] = b"".join([*parts, data[at:]]).decode()
            arrays = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in cols]
            yield pa.RecordBatch.from_arrays(arrays, cols).filter(pa.array(keep, pa.bool_()))

    return back(found.mapInArrow(run, schema))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit = [int((s := np.frombuffer(x, "<i8").reshape(-1, 4))[:, 1].sum() - s[:, 0].sum()) for x in batch.column("_hits").to_pylist()]
            items = batch.column("_items").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_n_words"), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([x > 0 for x in n_hit])],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return found.select("doc_id", "_n_words", "_hits", "_items").mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT DISTINCT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
