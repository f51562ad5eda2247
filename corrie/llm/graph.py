"""Connected components of links: alternating large-star and small-star steps, or union-find in one task for at most ONE_TASK links."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Links (16 bytes each) that one task may hold.
ONE_TASK = 1 << 20


def union_find(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, at = np.unique(pdf[["a", "b"]].to_numpy(np.int64), return_inverse=True)
    parent = list(range(len(ids)))
    for a, b in at.reshape(-1, 2).tolist():
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        parent[max(a, b)] = min(a, b)
    for i in range(len(parent)):
        parent[i] = parent[parent[i]]  # parents come before their children
    return pd.DataFrame({"id": ids, "comp": ids[parent]})


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """From a, b (long) to id, comp: the smallest id that each linked id reaches.

    Every step only takes minima of neighbours, so an id with very many links is pre-aggregated before the shuffle.
    """
    e = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = scratch.cut(e, f"{name}-0")
    if e.count() <= ONE_TASK:
        return scratch.cut(e.coalesce(1).groupBy(F.lit(0).alias("g")).applyInPandas(union_find, "id long, comp long"), f"{name}-all")
    step = 0
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(low.filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).distinct()
        step += 1
        new = scratch.cut(small, f"{name}-{step}")
        parents = new.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        open_ = parents.filter("n > 1").limit(1).count() or new.join(new.select(F.col("a").alias("b")).distinct(), "b", "leftsemi").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        e = new
        if not open_:
            break
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(e.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())
