"""Exact top-k inner products by norm buckets."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.vectors import best, commonest_size, distinct_best, finite, matrix

#: Bounds are widened by this share, more than their rounding errors.
_SLACK = 1e-9
_LONG = (-(1 << 63), (1 << 63) - 1)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles. Beyond what doubles or longs hold, Python's integers are used."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q))
    if most < 2.0**53:
        return (x @ q).astype(np.int64)
    whole = [int(b) for b in q]
    return np.array([min(_LONG[1], max(_LONG[0], sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in x], np.int64)


class Bucket:
    """Rows of similar length, longest first, with their unit vectors sorted along any coordinate that a query asks for."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        norm = np.sqrt((x * x).sum(axis=1))
        order = np.argsort(-norm, kind="stable")
        self.ids, self.x, self.norm = ids[order], x[order], norm[order]
        self.unit = self.x / np.maximum(self.norm, 1e-300)[:, None]
        self.repeats = len(np.unique(ids)) < len(ids)
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def candidates(self, q: np.ndarray, least: float) -> np.ndarray:
        """Rows whose product with ``q`` may reach ``least``.

        The local cosine threshold is least / (|q| * longest). If high, a coordinate on which the query is large confines the
        unit vectors to a short range, found by bisection in the sorted coordinate; else rows too short for any cosine go.
        """
        length = float(np.sqrt((q * q).sum()))
        if least <= 0 or length == 0 or not len(self.norm):
            return np.arange(len(self.norm))
        long_enough = int(np.searchsorted(-self.norm, -(least / length) * (1 - _SLACK), side="right"))
        cosine = least / (length * self.norm[0]) * (1 - _SLACK) - _SLACK
        if cosine >= 1:
            return np.arange(long_enough)
        f = int(np.abs(q).argmax())
        share = q[f] / length
        angle, reach = np.arccos(np.clip(share, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
        low, high = np.cos(min(np.pi, angle + reach)) - _SLACK, np.cos(max(0.0, angle - reach)) + _SLACK
        if high - low > 0.5:
            return np.arange(long_enough)
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.sorted[f] = (order, self.unit[order, f])
        order, values = self.sorted[f]
        found = order[np.searchsorted(values, low) : np.searchsorted(values, high, side="right")]
        return found[found < long_enough]

    def top(self, q_id: int, q: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.candidates(q, least)
        at = at[self.ids[at] != q_id]
        score = products(self.x[at], q)
        reach = score >= least
        score, ids = score[reach], self.ids[at][reach]
        if not self.repeats and len(score) > k:
            near = score >= np.partition(score, len(score) - k)[len(score) - k]
            score, ids = score[near], ids[near]
        order = distinct_best(ids, score)[:k]
        return ids[order], score[order]


def top_products(
    df: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    k: int = 10,
    buckets: int = 64,
    block_rows: int = 8192,
    block_queries: int = 4096,
    seed_rows: int = 2048,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): exactly the ``k`` highest inner products of floor(``scale`` * x) for each query.

    * Rows are bucketed by length, at quantiles of it; a bucket is dealt over blocks of about ``block_rows``.
    * The ``seed_rows`` longest rows are broadcast, and a query's k-th best product with them is its threshold.
    * A query goes to the buckets whose longest row can reach the threshold. There, coordinate or length pruning leaves
      candidates, whose products are computed in whole numbers; up to k ids a block remain, each with its best row, and the best k of all are returned.
    * Queries are dealt over groups of about ``block_queries``, in order of the length that their thresholds ask for: a block of rows
      goes only to the groups that it can serve, and no task holds all queries.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id or another number of
    components than most. A row does not find its own id; ties go to the smaller id; of rows that share an id the best counts.
    Without rows or queries the result is empty; other columns are not read. Needs a checkpoint directory.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))

    def use(x: DataFrame) -> DataFrame:
        x = x.filter(F.col(id_col).isNotNull() & finite(vector_col))
        scaled = F.transform(vector_col, lambda y: F.lit(float(scale)) * y.cast("double"))
        # a double of 2**52 and more is whole, and a long could not hold all of them
        whole = F.transform(scaled, lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y))
        return x.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))

    rows, asked = use(df), use(queries)
    d = max(1, commonest_size(rows, "v"))
    rows = rows.filter(F.size("v") == d).withColumn("norm", norm)
    asked = asked.filter(F.size("v") == d)
    edges = sorted(set(rows.approxQuantile("norm", [i / buckets for i in range(1, buckets)], 0.002))) if d else []
    placed = rows.withColumn("bucket", F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e <= F.col("norm"))))
    stats = {r.bucket: (r.n, r.longest) for r in placed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}
    blocks = {b: ceil(n / block_rows) for b, (n, _) in stats.items()}
    seeds = rows.orderBy(F.desc("norm"), "id").limit(seed_rows).collect()
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((np.array([s.id for s in seeds], np.int64), np.array([s.v for s in seeds], np.float64).reshape(-1, d)))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's threshold, and the length that a row must have to reach it."""
        seed_ids, seed = shared.value
        repeats = len(np.unique(seed_ids)) < len(seed_ids)
        for batch in batches:
            q, ids, least, reach = matrix(batch.column(1), d), batch.column(0).to_numpy(), [], []
            for i in range(len(ids)):
                other = seed_ids != ids[i]
                score = products(seed[other], q[i])
                if repeats:
                    score = score[distinct_best(seed_ids[other], score)]
                least.append(float(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else float(_LONG[0]))
                length = float(np.sqrt((q[i] * q[i]).sum()))
                reach.append(least[-1] / length * (1 - _SLACK) if least[-1] > 0 and length > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.float64()), pa.array(reach, pa.float64())], names=["id", "v", "least", "reach"])

    bounded = asked.select("id", "v").mapInArrow(bound, "id long, v array<double>, least double, reach double").checkpoint()
    groups = ceil(bounded.count() / block_queries)
    steps = sorted(set(bounded.approxQuantile("reach", [i / groups for i in range(1, groups)], 0.01))) if groups > 1 else []
    stepped = bounded.withColumn("step", F.size(F.filter(F.array(*map(F.lit, steps)).cast("array<double>"), lambda e: e <= F.col("reach"))))
    found_steps = stepped.groupBy("step").agg(F.count("*").alias("n"), F.min("reach").alias("reach")).orderBy("step").collect()
    # a step of many equal thresholds is cut by a hash; groups are numbered in order of the length they ask for
    first, n_groups, reaches = {}, 0, []
    for r in found_steps:
        first[r.step] = (n_groups, ceil(r.n / (2 * block_queries)))
        n_groups += first[r.step][1]
        reaches += [r.reach] * first[r.step][1]
    serves = {b: sum(x <= longest for x in reaches) for b, (_, longest) in stats.items()}

    def number(of: dict, at: F.Column) -> F.Column:
        return F.create_map(*(F.lit(x) for kv in of.items() for x in kv))[at] if of else F.lit(1)

    bucket, step = F.col("bucket"), F.col("step")
    dealt = placed.filter(number(serves, bucket) > 0).withColumn("block", F.pmod(F.xxhash64("id", "v"), number(blocks, bucket)).cast("int"))
    dealt = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), number(serves, bucket) - 1)))
    within = F.pmod(F.xxhash64("id", "v", F.lit(1)), number({s: n for s, (_, n) in first.items()}, step))
    asked = stepped.withColumn("group", (number({s: at for s, (at, _) in first.items()}, step) + within).cast("int"))
    shape = "array<struct<bucket:int,longest:double,blocks:int>>"
    all_buckets = F.array(*(F.struct(F.lit(b), F.lit(longest), F.lit(blocks[b])) for b, (_, longest) in stats.items())).cast(shape)
    sent = asked.withColumn("at", F.explode(F.filter(all_buckets, lambda b: b["longest"] >= F.col("reach"))))
    sent = sent.select("at.bucket", F.explode(F.sequence(F.lit(0), F.col("at.blocks") - 1)).alias("block"), "group", "id", "v", "least")

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, least = left.column("id").to_numpy(), left.column("least").to_numpy()
        q = matrix(left.column("v"), d)
        bucket = Bucket(right.column("id").to_numpy(), matrix(right.column("v"), d))
        found = [(q_ids[i], *bucket.top(q_ids[i], q[i], least[i], k)) for i in range(len(q_ids))] if len(bucket.ids) else []
        empty = np.zeros(0, np.int64)
        cols = [np.concatenate([empty, *(np.full(len(f[1]), f[0]) for f in found)]), np.concatenate([empty, *(f[1] for f in found)]), np.concatenate([empty, *(f[2] for f in found)])]
        return pa.Table.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["query_id", "vec_id", "score"])

    key = ("bucket", "block", "group")
    found = sent.groupBy(*key).cogroup(dealt.select(*key, "id", "v").groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score long")
    return best(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k, F.desc("score"))
