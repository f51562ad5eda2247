"""Exact top-k search by inner product: a KD-tree for each shard of the vectors.

Vectors are turned into integers. Of equal ones only the rows of the k + 1 smallest vec_ids can be among the k best of any
query, as they score alike; the others are left out of the search. The rest are dealt into shards by a hash. A shard's tree splits at medians of the
widest dimension down to leaves of LEAF vectors; every node has the tight bounding box of its vectors, which bounds the
inner product with a query from above. A query visits nodes best bound first and stops once the best open bound can't
beat its k-th best score. That score is propagated: a first pass takes each query's best leaf in every shard, and the
k-th best of those over all shards is where the second pass starts. There a leaf whose box reaches the floor of some
queries of a block is scored for all of these at once, and its best score is its bound; a query then opens only leaves
that may hold one of its results. Trees are written to the shared folder once. Queries are packed into blocks of
QUERY_BLOCK; each pass is one job, in which every block meets every shard's tree by a product of the two tables: a task
reads up to about TASK_SIDE blocks and as many trees from the shared folder, so that neither is broadcast nor repeated in
a shuffle. It holds its blocks, one tree at a time, and for each of its queries the k best so far, whose k-th score counts
for its other trees too. Blocks, floors and results stay in tables.

A component beyond a long is the nearest long, and so is a score: ranks and ties follow from these.

Edge cases: vectors that are null or hold null or non-finite components take no part, neither as queries; vectors meet
only vectors of as many components (an empty one scores 0 with others); "the query's own" rows are those of its vec_id,
and rows with a null vec_id take no part; rows that share a vec_id are as many candidates, and as queries as many times;
ties go to the smaller vec_id; an empty table gives no rows; fewer candidates than k give fewer ranks.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, one_row, small_batches, table

SCALE = 256
SHARD_ROWS = 16384
LEAF = 256
QUERY_BLOCK = 4096
SCORES = 1 << 18
TASK_SIDE = 16
BATCH_BYTES = 1 << 23
K = 5
LONGS = (-(1 << 63), (1 << 63) - 1)
FOUND = "block long, query_no long, query_id long, vec_id long, score long"


class Tree:
    """Nodes in the order they are made; children of node i are kids[i] and kids[i] + 1, or it is a leaf (0)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.lexsort((*x.T[::-1], ids)) if x.shape[1] else np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        lo, hi, start, end, kids, parts = [], [], [], [], [], []
        nodes: list[tuple[np.ndarray, int]] = [(np.arange(len(ids)), 0)]
        i = 0
        while i < len(nodes):
            rows, starts = nodes[i]
            part = self.x[rows]
            low, high = (part.min(0), part.max(0)) if x.shape[1] else (part[:1].ravel(), part[:1].ravel())
            lo.append(low)
            hi.append(high)
            start.append(starts)
            end.append(starts + len(rows))
            if len(rows) > LEAF and x.shape[1] and (high > low).any():
                d = int((high.astype(float) - low).argmax())
                by = np.argpartition(part[:, d], len(rows) // 2)
                left, right = rows[by[: len(rows) // 2]], rows[by[len(rows) // 2 :]]
                kids.append(len(nodes))
                nodes += [(left, starts), (right, starts + len(left))]
            else:
                kids.append(0)
                parts.append((starts, rows))
            i += 1
        perm = np.concatenate([r for _, r in sorted(parts, key=lambda p: p[0])])
        self.ids, self.x = self.ids[perm], _narrow(self.x[perm])
        self.lo, self.hi = _narrow(np.array(lo)), _narrow(np.array(hi))
        self.start, self.end, self.kids = np.array(start), np.array(end), np.array(kids)
        self.big = float(np.abs(self.x.astype(float)).max(initial=0))

    def _tighter(self, bound: np.ndarray, qs: np.ndarray, x: np.ndarray, least: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """Bounds in which a node has the better of its two children's, and a leaf whose box reaches `least` the best score in it, for the queries in `scored`. These are multiplied with a leaf at once."""
        by = np.ascontiguousarray(bound.T)
        for node in range(len(by) - 1, -1, -1):  # children come after their parents
            if kid := self.kids[node]:
                np.maximum(by[kid], by[kid + 1], out=by[node])
                continue
            rows = np.flatnonzero(scored & (by[node] >= least))
            leaf = x[self.start[node] : self.end[node]]
            step = max(1, SCORES // len(leaf))
            for a in range(0, len(rows), step):
                by[node, rows[a : a + step]] = (qs[rows[a : a + step]] @ leaf.T).max(1)
        return np.ascontiguousarray(by.T)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, least: np.ndarray, first_leaf: bool) -> list[list[tuple[int, int]]]:
        """For each query its best (score, vec_id) here, none under `least`; of its best leaf only, if first_leaf."""
        most = self.x.shape[1] * self.big * float(np.abs(q.astype(float)).max(initial=0))
        exact = most < 2**52
        kind = np.float32 if most < 2**23 else np.float64 if exact else object
        x, qs = self.x.astype(kind), q.astype(kind)
        lo, hi = self.lo.astype(kind), self.hi.astype(kind)
        bound = np.maximum(qs, 0) @ hi.T + np.minimum(qs, 0) @ lo.T if q.shape[1] else np.zeros((len(q), len(self.lo)))
        if not exact:
            bound = np.clip(bound, *LONGS)
        else:
            bound = self._tighter(bound, qs, x, least, (least > LONGS[0]) & (not first_leaf))
        kids, start, end = self.kids.tolist(), self.start.tolist(), self.end.tolist()
        out: list[list[tuple[int, int]]] = []
        for i in range(len(q)):
            best: list[tuple[int, int]] = []  # a heap of (score, -vec_id): the worst first
            floor = int(least[i])
            row = bound[i].tolist()
            open_ = [(-row[0], 0)]
            while open_:
                b, node = heapq.heappop(open_)
                if -b < floor:
                    break
                kid = kids[node]
                if kid:
                    for c in (kid, kid + 1):
                        if row[c] >= floor:
                            heapq.heappush(open_, (-row[c], c))
                    continue
                a, z = start[node], end[node]
                scores = x[a:z] @ qs[i] if q.shape[1] else np.zeros(z - a)
                if not exact:
                    scores = np.clip(scores, *LONGS)
                ids = self.ids[a:z]
                ok = np.flatnonzero(scores >= floor)
                ok = ok[ids[ok] != own[i]]
                if len(ok) > k:
                    ok = ok[scores[ok] >= np.partition(scores[ok], len(ok) - k)[len(ok) - k]]
                    ok = ok[np.lexsort((ids[ok], -scores[ok]))[:k]] if exact else np.array(sorted(ok, key=lambda j: (-scores[j], ids[j]))[:k])
                for j in ok.tolist():
                    item = (int(scores[j]), -int(ids[j]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k:
                    floor = max(floor, best[0][0])
                if first_leaf:
                    break
            out.append([(s, -v) for s, v in best])
        return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes that hold them all."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array<long>) of the vectors that take part."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce((F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    v = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return embeddings.filter(ok & F.col("vec_id").isNotNull()).select("vec_id", v.alias("v"))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), np.int64).reshape(len(col), -1)


def _apart(data: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the rows of the k + 1 smallest vec_ids, one of which may be the query's own; every task keeps only these before the shuffle."""
    order = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    return data.select("vec_id", "v", F.dense_rank().over(order).alias("no")).filter(F.col("no") <= k + 1).drop("no")


def top_k(data: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """From vec_id, v of the candidates and of the queries: query_id, rank, vec_id, score."""
    spark = data.sparkSession
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)  # a row of a pass holds a tree and a block
    scratch = Scratch(spark)
    data = scratch.cut(_apart(data, k), "vectors")
    n_shards = max(1, -(-data.count() // SHARD_ROWS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["v"]))
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "tree": [pickle.dumps(tree)]})

    dealt = data.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_shards)).alias("shard"))
    trees = scratch.cut(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary"), "trees", 1)
    scratch.drop("vectors")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """block: its number; dim; and its queries' vec_ids and components."""
        held: dict[int, tuple[list[int], list[list[int]]]] = {}
        no = TaskContext.get().partitionId() << 32

        def out(dim: int) -> pa.RecordBatch:
            nonlocal no
            ids, v = held.pop(dim)
            no += 1
            return pa.RecordBatch.from_arrays([pa.array([no]), pa.array([dim], pa.int32()), one_row(np.array(ids, "<i8")), one_row(_narrow(np.array(v, "<i8")).ravel())], ["block", "dim", "ids", "q"])

        for batch in batches:
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(vec_id)
                rows.append(v)
                if len(ids) == QUERY_BLOCK:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    tasks = max(1, min(n_shards, 2 * spark.sparkContext.defaultParallelism))
    blocks = scratch.cut(queries.select("vec_id", "v").coalesce(tasks).mapInArrow(pack, "block long, dim int, ids binary, q binary"), "queries", 1)
    first = scratch.cut(_best(_visit(trees, blocks, n_shards, k, True), k).filter(F.col("rank") == k), "first")
    floors = first.groupBy("block").agg(F.collect_list(F.struct("query_no", "score")).alias("floors"))  # of the QUERY_BLOCK queries of a block
    floored = scratch.cut(blocks.join(floors.hint("merge"), "block", "left"), "floored", 1)
    found = _visit(trees, floored, n_shards, k, False)
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with rank; every task keeps only k of a query before the shuffle."""
    order = Window.partitionBy("block", "query_no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class _Found:
    """The best so far for the queries of a block, and the scores to beat."""

    def __init__(self, ids: np.ndarray, floors: list[dict[str, int]]) -> None:
        self.ids, self.floor = ids, np.full(len(ids), LONGS[0])
        for f in floors:
            self.floor[f["query_no"]] = f["score"]
        self.no = self.vec_id = self.score = np.zeros(0, np.int64)

    def add(self, got: list[list[tuple[int, int]]], k: int) -> None:
        flat = np.array([(j, v, s) for j, best in enumerate(got) for s, v in best], np.int64).reshape(-1, 3)
        no, vec_id, score = (np.concatenate([a, b]) for a, b in zip((self.no, self.vec_id, self.score), flat.T, strict=True))
        order = np.lexsort((vec_id, ~score, no))  # ~: downwards, also of the least long
        no, vec_id, score = no[order], vec_id[order], score[order]
        rank = np.arange(len(no)) - np.searchsorted(no, no)
        last = rank == k - 1
        self.floor[no[last]] = np.maximum(self.floor[no[last]], score[last])
        self.no, self.vec_id, self.score = no[rank < k], vec_id[rank < k], score[rank < k]


def _visit(trees: DataFrame, blocks: DataFrame, n_shards: int, k: int, first: bool) -> DataFrame:
    """The best of each task's shards for the queries of each of its blocks, from the block's floors on if it has some."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Found] = {}
        at, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                dim, block = row["dim"].as_py(), row["block"].as_py()
                if at != (dim, row["shard"].as_py()):  # a tree meets all blocks of the task before the next comes
                    at, tree = (dim, row["shard"].as_py()), pickle.loads(row["tree"].as_buffer())
                if block not in held:
                    held[block] = _Found(np.frombuffer(row["ids"].as_py(), "<i8"), [] if first else row["floors"].as_py() or [])
                best, q = held[block], row["q"].as_buffer()
                q = np.frombuffer(q, f"<i{q.size // (len(best.ids) * dim)}" if dim else "<i8").reshape(len(best.ids), dim)
                best.add(tree.search(q, best.ids, k, best.floor, first), k)
        for block in list(held):
            best = held.pop(block)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(best.no), block), best.no, best.ids[best.no], best.vec_id, best.score)], ["block", "query_no", "query_id", "vec_id", "score"])
        give_back()

    few = max(1, -(-blocks.count() // TASK_SIDE))
    many = max(1, -(-4 * trees.sparkSession.sparkContext.defaultParallelism // few), -(-n_shards // TASK_SIDE))
    # The product streams the trees past the blocks of a task; the hint keeps Spark from broadcasting either by its size on disk.
    every = trees.coalesce(many).hint("shuffle_replicate_nl").join(blocks.coalesce(few), "dim")
    return every.mapInArrow(visit, FOUND)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(data, data.filter("vec_id % 50 = 0"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
