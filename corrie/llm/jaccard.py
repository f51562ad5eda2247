"""N-gram Jaccard join by T-occurrence search with DivideSkip, and the groups that its links make.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a document's set holds its distinct SHINGLE-word shingles as
64-bit hashes. Two documents link when 100 * intersection >= THRESHOLD * union.

How the work is kept near the size of the input, without losing a link:

1. Shingles are counted. A linked document shares at least THRESHOLD percent of its shingles with other documents, so
   only documents with as many shared shingles go on. Shingles travel as packed sorted arrays, one row for each bucket
   of hashes and block of documents; the bucket's answer is packed the same way. What a block can tell alone isn't sent:
   a shingle that two of its documents hold is shared, and the bucket only gets two marks of it, so a shingle that all
   documents hold sends two marks a block, not one a document.
2. Documents with equal sets become one class.
3. Classes meet in shards by a min-hash of their sets; a shard of more than CAP classes is split at random into parts of
   about CAP, which are groups of their own. A part is searched by T-occurrence search: the inverted lists of a query's
   shingles are divided into long and short ones, the short ones are merged on a heap that skips, the long ones are
   probed by binary search. Jaccard distance is a metric, so a query only searches the members of clusters whose leader
   has half of its shingles.
4. Links so far give components. Step 1 is repeated with components in place of documents: only documents with THRESHOLD
   percent of their shingles in other components can have a link that is still missing. Put a set's shingles in one
   order that is the same for all sets, those that few of these sets hold first: two of n and m shingles that link have
   one of their n - ceil(0.75 n) + 1 and m - ceil(0.75 m) + 1 first ones in common. So sets that have one of these in
   common, directly or over others, make a part, and each set goes whole to its part, once. A part of more than
   PART_SHINGLES shingles is cut into blocks, and every two blocks meet in a task of their own. T-occurrence search
   finds the links in a task; only a spanning forest comes out.

So every pair of components that a link joins is joined, however large a group of copies is; copies aren't expanded into
pairs. CAP, PART_SHINGLES and graph.ONE_TASK bound what a task holds; no result depends on them.

Edge cases: null, empty and word-free texts have empty sets and link with nothing; fewer words than SHINGLE are one
shingle; rows that agree in doc_id and text are one document with as many result rows; rows that share only a doc_id are
told apart; an empty table gives no rows; other columns pass.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, chunks, give_back, one_row, packed, row_key, shield, small_batches, table, text_buffers, unpacked
from .graph import components
from .textnp import LOWER, SPACE, mix, prefix_hash, span_hash, window_hash, words

SHINGLE = 5
THRESHOLD = 75
CAP = 400
BUCKET_BYTES = 8 << 20
BLOCK_SHINGLES = 1 << 19
BLOCK_DOCS = 1 << 16
PART_SHINGLES = 1 << 17
TASK_SHINGLES = 1 << 18
HOT_SHINGLES = 1000
_LOW = np.int64(-1 << 63)
#: Weight of a heap operation against a binary probe in DivideSkip's choice of the number of long lists.
MU = 0.0085
SEEDS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = LOWER[data]
    starts, ends, wo = words(data, offs, ~SPACE)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (len(offs) - 1)
    h = span_hash(prefix_hash(data), starts, ends)
    g = window_hash(h, n)
    out = []
    for a, b in zip(wo[:-1].tolist(), wo[1:].tolist(), strict=True):
        out.append(np.unique(g[a : b - n + 1]) if b - a >= n else window_hash(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def links(o: int, n: int, m: int) -> bool:
    return 100 * o >= THRESHOLD * (n + m - o)


class Index:
    """Inverted lists from shingles to the numbers of the sets added so far."""

    def __init__(self) -> None:
        self.lists: dict[int, list[int]] = {}
        self.sizes: list[int] = []

    def add(self, items: list[int]) -> None:
        at, lists = len(self.sizes), self.lists
        for x in items:
            if x in lists:
                lists[x].append(at)
            else:
                lists[x] = [at]
        self.sizes.append(len(items))

    def search(self, items: list[int], percent: int) -> list[tuple[int, int]]:
        """Sets with a Jaccard similarity of `percent` or more to `items`, with the intersection's size."""
        n = len(items)
        t = max(1, -(-percent * n // 100))
        found = [x for x in map(self.lists.get, items) if x is not None]
        if len(found) < t:
            return []
        found.sort(key=len)
        n_long = min(t - 1, int(t / (MU * math.log2(len(found[-1]) + 1) + 1)))
        short, long = found[: len(found) - n_long], found[len(found) - n_long :]
        out = []
        for at, o in merge_skip(short, t - n_long):
            m = self.sizes[at]
            need = max(t, -(-percent * (n + m) // (100 + percent)))
            left = n_long
            for x in reversed(long):  # the longest likeliest hold it
                if o + left < need:
                    break
                left -= 1
                i = bisect_left(x, at)
                o += i < len(x) and x[i] == at
            if o >= need and 100 * o >= percent * (n + m - o):
                out.append((at, o))
        return out


def merge_skip(lists: list[list[int]], t: int) -> Iterator[tuple[int, int]]:
    """Numbers found in at least t of the ascending lists, with the number of lists that hold them."""
    heap = [(x[0], i) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    pos = [0] * len(lists)
    while len(heap) >= t:
        at, popped = heap[0][0], []
        while heap and heap[0][0] == at:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= t:
            yield at, len(popped)
            low = at + 1
        else:
            while len(popped) < t - 1 and heap:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            low = heap[0][0]
        for i in popped:
            x = lists[i]
            pos[i] = p = bisect_left(x, low, pos[i])
            if p < len(x):
                heapq.heappush(heap, (x[p], i))


def search_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that join all sets of the shard that are joined by links within it: a spanning forest as a, b."""
    ids = pdf["r"].tolist()
    sets = [np.frombuffer(x, "<u8").tolist() for x in pdf["set"]]
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    leaders, heads, members, inner = Index(), [], [], []
    out: list[tuple[int, int]] = []

    def join(q: int, x: int) -> None:
        if root(q) != root(x):
            parent[root(q)] = root(x)
            out.append((ids[q], ids[x]))

    for q, items in enumerate(sets):
        near = leaders.search(items, 100 - 2 * (100 - THRESHOLD))
        own = None
        for c, o in near:
            if links(o, len(items), len(sets[heads[c]])):
                own = c if own is None else own
                join(q, heads[c])
        for c, _ in near:
            if members[c] and root(heads[c]) != root(q):
                if inner[c] is None:
                    inner[c] = (Index(), [])
                index, held = inner[c]
                for x in members[c][len(held) :]:
                    index.add(sets[x])
                    held.append(x)
                for x, _ in index.search(items, THRESHOLD):
                    join(q, held[x])
        if own is None:
            leaders.add(items)
            heads.append(q)
            members.append([])
            inner.append(None)
        else:
            members[own].append(q)
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def search_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between components: a spanning forest of the components that links within the part join.

    Clusters hold sets of one component, so the copies in it aren't searched one by one, and components that a link has
    joined aren't searched any more.
    """
    pdf = pdf.drop_duplicates("r").sort_values("r")
    ids, labels = pdf["r"].tolist(), pdf["label"].tolist()
    sets = [np.frombuffer(x, "<u8").tolist() for x in pdf["set"]]
    parent = {x: x for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    # Leaders without members are searched at the similarity itself, only the others at what their members ask for.
    alone, alone_ids, crowd, crowd_ids = Index(), [], Index(), []
    heads, members, inner = [], [], []
    out: list[tuple[int, int]] = []

    def join(q: int, x: int) -> None:
        a, b = root(labels[q]), root(labels[x])
        if a != b:
            parent[a] = b
            out.append((ids[q], ids[x]))

    for q, items in enumerate(sets):
        own = None
        near_by = [(alone_ids[i], o) for i, o in alone.search(items, THRESHOLD) if not members[alone_ids[i]]]
        near_by += [(crowd_ids[i], o) for i, o in crowd.search(items, 100 - 2 * (100 - THRESHOLD))]
        for c, o in near_by:
            h = heads[c]
            near = links(o, len(items), len(sets[h]))
            if labels[h] == labels[q]:
                own = c if near and own is None else own
                continue
            if near:
                join(q, h)
            if members[c] and root(labels[h]) != root(labels[q]):
                if inner[c] is None:
                    inner[c] = (Index(), [])
                index, held = inner[c]
                for x in members[c][len(held) :]:
                    index.add(sets[x])
                    held.append(x)
                for x, _ in index.search(items, THRESHOLD):
                    join(q, held[x])
        if own is None:
            alone.add(items)
            alone_ids.append(len(heads))
            heads.append(q)
            members.append([])
            inner.append(None)
        else:
            if not members[own]:
                crowd.add(sets[heads[own]])
                crowd_ids.append(own)
            members[own].append(q)
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _and_give_back(search: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = search(pdf)
        if len(pdf) > 50:
            give_back()
        return found

    return run


def _text_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        data, offs = text_buffers(batch.column("text"))
        k = batch.column("k").to_numpy(zero_copy_only=False)
        for i, j in chunks(offs):
            yield k[i:j], k[i:j], shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


def _stored_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        yield *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "label")), [np.frombuffer(x, "<u8") for x in batch.column("set").to_pylist()]


def _edges(b: np.ndarray, n: int) -> np.ndarray:
    """The least hashes of buckets b, of n."""
    b = b.astype(np.uint64) << np.uint64(32)
    return (b + np.uint64(n - 1)) // np.uint64(n) << np.uint64(32)


def shared_counts(rows: DataFrame, sets_of, n_buckets: int) -> DataFrame:
    """k, n and shared: of the n shingles of k, how many also occur under another label.

    rows has what `sets_of` reads. Rows of the same k count once in n; their shared counts may add up. Within a bucket
    32 bits of a hash travel, so a rare pair of different shingles counts as shared; a count is never below the true one.
    """
    shift = np.uint64(max(0, (-(-(1 << 64) // n_buckets) + (1 << 32)).bit_length() - 32))

    def pack(block: list[tuple[int, int, np.ndarray]], no: int) -> pa.RecordBatch:
        """A row for each bucket: ks and labels of the documents that have shingles there, after two that only mark a shingle as shared; h and at, each shingle with its document. The last row tells what the block knows itself."""
        ks, labels = np.array([x[0] for x in block], np.int64), np.array([x[1] for x in block], np.int64)
        ns = np.array([len(x[2]) for x in block], np.int64)
        h = np.concatenate([x[2] for x in block])
        of = np.repeat(np.arange(len(block), dtype=np.int32), ns)
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        many = np.minimum.reduceat(labels[of], first) != np.maximum.reduceat(labels[of], first)
        known = np.repeat(many, np.diff(np.r_[first, len(h)]))
        local = np.bincount(of[known], minlength=len(block))
        marked = h[first[many]]
        h, of = np.concatenate([h[~known], marked, marked]), np.concatenate([of[~known] + 2, np.zeros(len(marked), np.int32), np.ones(len(marked), np.int32)])
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        bucket = (h >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        some = bucket[cuts[:-1]].astype(np.int64)
        row = np.repeat(np.arange(len(some)), np.diff(cuts))
        own = np.concatenate([row << 17 | of, np.arange(len(some)) << 17, np.arange(len(some)) << 17 | 1])
        held, at = np.unique(own, return_inverse=True)
        held_cuts = np.searchsorted(held >> 17, np.arange(len(some) + 1))
        doc = held & (1 << 17) - 1
        at = at[: len(h)] - held_cuts[row]
        cols = [packed(((h - np.repeat(_edges(some, n_buckets), np.diff(cuts))) >> shift).astype("<u4"), cuts), packed(np.r_[0, 0, ks][doc], held_cuts), packed(np.r_[_LOW, ~_LOW, labels][doc], held_cuts), packed(at.astype("<u4"), cuts)]
        mine = [one_row(x) for x in (np.zeros(0, "<u4"), ks, ns, local)]
        return pa.RecordBatch.from_arrays([pa.array(np.r_[some, n_buckets + no % n_buckets], pa.int32()), *(pa.concat_arrays(x) for x in zip(cols, mine, strict=True))], ["bucket", "h", "ks", "labels", "at"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, no = [], 0, 0
        for ks, labels, sets in sets_of(batches):
            for k, label, s in zip(ks.tolist(), labels.tolist(), sets, strict=True):
                if len(s):
                    block.append((k, label, s))
                    size += len(s)
                if size >= BLOCK_SHINGLES or len(block) == BLOCK_DOCS:
                    yield pack(block, no)
                    block, size, no = [], 0, no + 1
        if block:
            yield pack(block, no + n_buckets // 2)

    def answer(rows: pa.Table) -> pa.Table:
        if rows.column("bucket")[0].as_py() >= n_buckets:
            ks, ns, cs = (unpacked(rows.column(c), "<i8")[0] for c in ("ks", "labels", "at"))
        else:
            ks, cuts = unpacked(rows.column("ks"), "<i8")
            labels = unpacked(rows.column("labels"), "<i8")[0]
            at, at_cuts = unpacked(rows.column("at"), "<u4")
            both = unpacked(rows.column("h"), "<u4")[0].astype(np.uint64)  # hash, then document: sorted in place
            both <<= np.uint64(32)
            both |= at + np.repeat(cuts[:-1].astype(np.uint32), np.diff(at_cuts))
            both.sort()
            of = both.astype(np.uint32)
            both >>= np.uint64(32)
            first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
            size = np.diff(np.r_[first, len(both)])
            own = labels[of]
            many = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
            cs = np.bincount(of[np.repeat(many, size)], minlength=len(ks))
            del both, own, of, at, first, size, many, labels
            give_back()
            cs[cuts[:-1]] = cs[cuts[:-1] + 1] = 0  # the marks
            ks, cs = ks[cs > 0], cs[cs > 0]
            ns = np.zeros(len(ks), np.int64)
        to = ks % n_buckets
        order = np.argsort(to, kind="stable")
        to = to[order]
        cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else np.zeros(1, np.int64)
        return pa.table([pa.array(to[cuts[:-1]], pa.int32()), *(packed(x[order].astype("<i8"), cuts) for x in (ks, ns, cs))], names=["to", "ks", "ns", "cs"])

    def total(rows: pa.Table) -> pa.Table:
        ks, ns, cs = (unpacked(rows.column(c), "<i8")[0] for c in ("ks", "ns", "cs"))
        order = np.argsort(ks, kind="stable")
        ks, ns, cs = ks[order], ns[order], cs[order]
        first = np.flatnonzero(np.r_[True, ks[1:] != ks[:-1]])
        return pa.table([ks[first], np.maximum.reduceat(ns, first), np.add.reduceat(cs, first)], names=["k", "n", "shared"])

    sent = rows.mapInArrow(send, "bucket int, h binary, ks binary, labels binary, at binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "to int, ks binary, ns binary, cs binary")
    return answers.groupBy("to").applyInArrow(total, "k long, n long, shared long")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ks, _, sets in _text_sets(batches):
        sign = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
        mins = [[int(s[np.argmin(mix(s ^ np.uint64(seed)))].view(np.int64)) if len(s) else 0 for s in sets] for seed in SEEDS]
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(sign, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(m, pa.int64()) for m in mins), pa.array([s.tobytes() for s in sets], pa.binary())], ["k", "r", "n", *(f"m{i}" for i in range(len(SEEDS))), "set"])


def _tasks(spark: SparkSession, shingles: int) -> int:
    """Searching takes long for its bytes: twice the cores, or a task for each TASK_SHINGLES."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-shingles // TASK_SHINGLES))


def _routed(left: DataFrame, scratch: Scratch) -> DataFrame:
    """part, r, label, set of the sets of left (k, n, label, set) that may link: two that do are in one part together."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, cuts = unpacked(batch.column("set"), "<i8")
            k, n = (np.repeat(batch.column(c).to_numpy(), np.diff(cuts)) for c in ("k", "n"))
            for i in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (k, n, h)], ["k", "n", "h"])

    total = left.agg(F.sum("n")).first()[0] or 0
    held = left.select("k", "n", "set").mapInArrow(explode, "k long, n long, h long")
    often = scratch.cut(held.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "often")
    hot = F.broadcast(often.filter(F.col("c") * HOT_SHINGLES > total))

    def joined(rows: DataFrame, by_shingle: DataFrame) -> DataFrame:
        """Those of hot shingles, less than HOT_SHINGLES, come by broadcast, so that no task gets all rows of one."""
        return rows.join(hot.select("h"), "h", "leftanti").join(by_shingle, "h").union(rows.join(F.broadcast(by_shingle.join(hot.select("h"), "h", "leftsemi")), "h"))

    # Shingles of one set alone come first in the order and lead nowhere; what is left of the first ones is taken here.
    own = Window.partitionBy("k")
    held = joined(held, often).withColumn("at", F.row_number().over(own.orderBy("c", "h")) + F.col("n") - F.count(F.lit(1)).over(own))
    first = scratch.cut(held.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * THRESHOLD / 100) + 1).select("k", "h"), "first")
    least = first.groupBy("h").agg(F.min("k").alias("a"))
    together = components(joined(first, least).select("a", F.col("k").alias("b")), scratch, "near")

    near = left.join(together, F.col("k") == F.col("id")).drop("id")
    blocks = near.groupBy("comp").agg(F.ceil(F.sum("n") / PART_SHINGLES).alias("blocks")).filter("blocks > 1")
    # At most one row for every PART_SHINGLES shingles of left; by a shuffle, all rows of a large part would meet in one task.
    near = near.join(F.broadcast(blocks), "comp", "left").withColumn("mine", F.pmod(F.xxhash64("k", F.lit("block")), F.coalesce("blocks", F.lit(1))))
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)))
    return near.select(F.xxhash64("comp", F.least("mine", "other"), F.greatest("mine", "other")).alias("part"), F.col("k").alias("r"), "label", "set").repartition(_tasks(left.sparkSession, total), "part")


def groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """k (row_key()), n and comp for documents with a shingle: comp is equal within a group, null for no link."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(row_key().alias("k"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(8, -(-size // BUCKET_BYTES))
    counts = scratch.cut(shared_counts(docs, _text_sets, n_buckets), "counts")
    likely = counts.filter(F.col("shared") * 100 >= F.col("n") * THRESHOLD).select("k")
    stored = "k long, r long, n long, " + ", ".join(f"m{i} long" for i in range(len(SEEDS))) + ", set binary"
    kept = scratch.cut(docs.join(likely, "k", "leftsemi").mapInArrow(_store, stored), "kept")
    reps = scratch.cut(kept.drop("k").dropDuplicates(["r"]), "reps")

    found, tasks = None, _tasks(spark, reps.agg(F.sum("n")).first()[0] or 0)
    for i in range(len(SEEDS)):
        own = reps.select("r", "set", F.col(f"m{i}").alias("key"))
        sizes = own.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        # The join has dealt rows by key; a part's own name makes a hot key's parts go to tasks of their own.
        own = own.join(sizes, "key").select("r", "set", F.xxhash64("key", F.pmod(F.xxhash64("r", F.lit(i)), F.ceil(F.col("c") / CAP))).alias("part"))
        own = own.repartition(tasks, "part").groupBy("part").applyInPandas(_and_give_back(search_shard), "a long, b long")
        found = own if found is None else found.union(own)
    found = scratch.cut(found, "links")
    comps = components(found, scratch, "first")

    left = reps.join(comps, F.col("r") == F.col("id"), "left").select(F.col("r").alias("k"), "n", F.coalesce("comp", "r").alias("label"), "set")
    left = scratch.cut(left, "left0")
    for i in range(2):
        few = shared_counts(left, _stored_sets, n_buckets)
        few = few.filter(F.col("shared") * 100 >= F.col("n") * THRESHOLD).select("k")
        left = scratch.cut(left.join(few, "k", "leftsemi"), f"left{i + 1}")
    if left.limit(1).count():
        more = scratch.cut(_routed(left, scratch).groupBy("part").applyInPandas(_and_give_back(search_part), "a long, b long"), "more")
        if more.limit(1).count():
            comps = components(found.union(more), scratch, "second")
    member = kept.groupBy("r").agg(F.count(F.lit(1)).alias("c"))
    member = member.join(comps, F.col("r") == F.col("id"), "left").select("r", F.when(F.col("comp").isNotNull(), F.col("comp")).when(F.col("c") > 1, F.col("r")).alias("comp")).filter("comp IS NOT NULL")
    member = kept.select("k", "r").distinct().join(member, "r").select("k", "comp")
    return scratch.cut(counts.select("k", "n").join(member, "k", "left"), "groups")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = groups(docs, Scratch(spark))
    own = docs.select("doc_id", row_key().alias("k")).join(found, "k", "left")
    least = own.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return own.join(least, "comp", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that with the smallest doc_id (of equal rows, one); unlinked rows stay.

    Rows that agree in doc_id and text and have a word are a group, too.
    """
    spark = docs.sparkSession
    docs, back = shield(docs, "doc_id", "text")
    cols = docs.columns
    found = groups(docs, Scratch(spark))
    ids = docs.select("doc_id", row_key().alias("_k")).join(found.withColumnRenamed("k", "_k"), "_k")
    best = ids.groupBy(F.coalesce("comp", "_k").alias("comp")).agg(F.min(F.struct("doc_id", "_k")).alias("best"), F.count(F.lit(1)).alias("c"))
    best = best.select(F.col("best._k").alias("_k"), "c")
    own = docs.withColumn("_k", row_key()).join(found.select(F.col("k").alias("_k"), F.lit(1).alias("_some")), "_k", "left")
    own = own.join(best, "_k", "left")
    alone = own.filter("_some IS NULL OR c = 1")
    first = own.filter("c > 1").dropDuplicates(["_k"])
    return back(alone.select(*cols).union(first.select(*cols)))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.node = l.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
