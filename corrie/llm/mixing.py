"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source s with n_s of N rows and target weight w_s gets the mean repetition rate w_s / sum(w) * N / n_s. Every document's
count is the inverse of the Poisson distribution of that mean at a hash of (seed, doc_id, text), so it is the same
wherever and how often it is computed. A source's cumulative distribution is computed once, a document's count is the
number of its values under the hash. Documents are exploded by their counts and ordered by another hash, mix_order: it is
uniform, so its high bits deal the copies into partitions, which are sorted one by one; nothing is sampled or computed
twice for that.

A mean over STEP is the sum of several Poissons of at most STEP each with hashes of their own, since exp(-mean) would
vanish. Inversion stops where the remaining probability is below the hash's resolution of 2**-48.

Edge cases: null is a source like any other; a null text counts as its own value; rows that agree in doc_id and text get
equal counts, each row its own copies; a source without a target weight gets `default_weight`; a weight of 0 drops the
source; an empty table gives no rows. `copy` and `mix_order` are added (a column of such a name is replaced), other
columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shield, table

SEED = "mix-1"
STEP = 32.0
#: Copies of each source's rate, so that a hot source's documents meet them in as many partitions.
SALT = 32


def _uniform(*parts: Column) -> Column:
    """48 bits of a hash as a number in (0, 1)."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _cumulative(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ..., X ~ Poisson(mean), mean <= STEP, as far as a hash can reach."""
    most = 40 + int(STEP * 4)
    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(a: Column, i: Column) -> Column:
        p = a["p"] * mean / i
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.concat(a["all"], F.array(a["c"] + p)).alias("all"))

    every = F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, step, lambda a: a["all"])
    return F.filter(every, lambda c: c < F.lit(1 - 0.5 / (1 << 48)))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0) -> DataFrame:
    """One row for each source: source, n_docs, rate."""
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    weight = F.lit(float(default_weight))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    n = n.withColumn("weight", weight)
    total = n.agg(F.sum("n_docs").alias("n_all"), F.sum("weight").alias("w_all"))
    return n.join(F.broadcast(total)).select("source", "n_docs", (F.col("weight") / F.col("w_all") * F.col("n_all") / F.col("n_docs")).alias("rate"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, seed: str = SEED, shuffle: bool = True) -> DataFrame:
    """docs exploded by Poisson counts, with copy (from 1) and mix_order, in mix_order if `shuffle`."""
    docs, back = shield(docs, "doc_id", "text", "source")
    cols = docs.columns
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.coalesce(F.md5("text"), F.lit("~")))
    r = rates(docs, weights, default_weight).withColumn("_parts", F.greatest(F.ceil(F.col("rate") / F.lit(STEP)).cast("int"), F.lit(1)))
    r = r.select(F.col("source").alias("_source"), "_parts", _cumulative(F.col("rate") / F.col("_parts")).alias("_cum"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    d = docs.withColumn("_key", key).withColumn("_at", F.pmod(F.xxhash64("_key"), F.lit(SALT)).cast("int"))
    d = d.join(r, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("_salt")))

    def below(i: Column) -> Column:
        u = _uniform(F.col("_key"), i.cast("string"))
        return F.aggregate(F.col("_cum"), F.lit(0), lambda n, c: n + (c < u).cast("int"))

    count = F.when(F.col("_parts") == 1, below(F.lit(1))).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda a, i: a + below(i)))
    d = d.withColumn("_n", count).filter("_n > 0")
    d = d.select(*cols, "_key", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    d = d.select(*cols, F.col("copy").cast("long").alias("copy"), F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("order"), F.col("_key"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long").alias("mix_order"))
    if shuffle:
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        d = d.repartitionById(n, F.least(F.floor(F.col("mix_order") / float(1 << 60) * n), F.lit(n - 1)).cast("int")).sortWithinPartitions("mix_order", "doc_id", "copy")
    return back(d, "copy", "mix_order")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy that equal weights for all sources give: doc_id, source, copy, mix_order and the copy's text hash."""
    return replicate(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "copy", "mix_order", "text")


OP10_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM n) * (SELECT sum(n_docs)::BIGINT FROM n) / n_docs AS rate FROM n),
p AS (SELECT source, rate, greatest(ceil(rate / 32.0::DOUBLE)::INT, 1) AS parts FROM r),
q AS (SELECT source, parts, rate / parts AS mean FROM p),
c(source, k, pk, ck, mean) AS (
  SELECT source, 0, exp(-mean), exp(-mean), mean FROM q
  UNION ALL
  SELECT source, k + 1, pk * mean / (k + 1), ck + pk * mean / (k + 1), mean FROM c WHERE k < 168),
cum AS (SELECT source, list(ck ORDER BY k) AS cks FROM c GROUP BY source),
d AS (SELECT doc_id, d.source, text, concat_ws('|', 'mix-1', coalesce(CAST(doc_id AS VARCHAR), '~'), coalesce(md5(text), '~')) AS key, parts
      FROM documents d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
u AS (SELECT doc_id, d.source, text, key, unnest(range(1, parts + 1)) AS i FROM d),
v AS (SELECT doc_id, u.source, text, key, len(list_filter(cks, lambda x: x < (CAST('0x' || md5(concat_ws('|', key, CAST(i AS VARCHAR)))[1:12] AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)) AS k
      FROM u JOIN cum ON u.source IS NOT DISTINCT FROM cum.source),
w AS (SELECT doc_id, source, text, key, CAST(sum(k) AS BIGINT) AS n FROM v GROUP BY ALL)
SELECT doc_id, source, copy, CAST('0x' || md5(concat_ws('|', 'order', key, CAST(copy AS VARCHAR)))[1:15] AS BIGINT) AS mix_order, text
FROM (SELECT doc_id, source, text, key, unnest(range(1, n + 1)) AS copy FROM w)
"""
