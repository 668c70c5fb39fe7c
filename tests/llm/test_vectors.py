import math

import numpy as np
from pyspark.sql import types as T

from tidemark.llm import ann, topk

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rank", T.StringType())])


def vectors(n=900, d=16, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x[: n // 2] = x[r.integers(0, 8, n // 2)] + r.normal(size=(n // 2, d)) * 0.1
    x[:9] = x[0]
    x *= r.lognormal(0, 1, (n, 1))
    return [(i, [float(v) for v in row.astype(np.float32)], "x") for i, row in enumerate(x)]


ODD = [(5000, None, None), (5100, [0.0] * 16, None), (5200, [float("nan")] * 16, None), (5300, [1.0] * 15 + [None], None), (5400, [float("inf")] + [1.0] * 15, None), (5500, [1.0], None), (5600, [], None), (None, [1.0] * 16, None)]


def brute(rows, score, best_last, zero):
    use = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    out = set()
    for i, q in use:
        if i % 100 == 0:
            all_ = {}
            for j, v in use:
                if j != i:
                    s = score(q, v)
                    all_[j] = s if j not in all_ else (max if best_last else min)(s, all_[j])
            order = sorted(all_.items(), key=lambda x: (-x[1] if best_last else x[1], x[0]))[:10]
            out |= {(i, n, j, s) for n, (j, s) in enumerate(order, 1)}
    return out


def test_nearest(spark):
    rows = vectors() + ODD + [(3, vectors()[3][1], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, lambda q, v: float(np.sqrt(((v - q) ** 2).sum())), False, False)
    full = {tuple(r) for r in ann.nearest(df, df.filter("vec_id % 100 = 0"), least_rows=10**9, block_rows=20, block_queries=4).collect()}
    assert full == want
    some = {tuple(r) for r in ann.nearest(df, df.filter("vec_id % 100 = 0"), leaf_points=8, least_rows=0, sample_rows=400).collect()}
    pairs = lambda x: {(a, c) for a, _, c, _ in x}
    assert len(pairs(some) & pairs(want)) >= 0.9 * len(want)
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0
    assert ann.nearest(df.filter("vec_id in (1, 100)"), df.filter("vec_id = 100")).collect()[0].vec_id == 1


def test_nearest_budget_counts_distinct_rows(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 16))
    x[np.arange(1500) % 3 == 1] = 0.05
    rows = [(i, [float(v) for v in row.astype(np.float32)], None) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(a, c) for a, _, c, _ in brute(rows, lambda q, v: float(np.sqrt(((v - q) ** 2).sum())), False, False)}
    got = {(q.query_id, q.vec_id) for q in ann.nearest(df, df.filter("vec_id % 100 = 0"), least_rows=0).collect()}
    assert 0.9 * len(want) <= len(got & want)


def test_the_budget_reaches_the_recall_without_reading_most():
    """Random vectors, which no tree can tell apart well: the share that the sample asks for finds 0.9 in a table ten times as large."""
    r = np.random.default_rng(3)
    x = r.normal(size=(40_000, 64))
    forest = ann.plant(x[:4000], 10.0, trees=8, leaf_points=8, k=10, recall=0.95, checks=100, least_rows=320, seed=1)
    assert 0.1 < forest.budget / 4000 < 0.6
    leaves = [t.leaves(x) for t in forest.trees]
    queries, hits, read = x[-40:], 0, 0
    costs = forest.costs(queries)
    for i, q in enumerate(queries):
        visited = np.zeros(len(x), bool)
        for t, leaf in forest.probe(costs, i):
            visited |= leaves[t] == leaf
        near = np.argsort(((x - q) ** 2).sum(axis=1))[1:11]
        hits, read = hits + visited[near].sum(), read + visited.mean()
    assert hits >= 0.9 * 400 and read < 0.6 * 40


def test_clusters_need_little():
    r = np.random.default_rng(3)
    x = r.normal(size=(100, 32))[r.integers(0, 100, 8000)] * 5 + r.normal(size=(8000, 32))
    assert ann.plant(x, 1.0, trees=8, leaf_points=16, k=10, recall=0.95, checks=100, least_rows=0, seed=1).budget < 0.15 * 8000


def test_a_leaf_of_copies_does_not_end_the_search():
    r = np.random.default_rng(6)
    x = r.normal(size=(900, 8))
    x[:300] = 0.5
    forest = ann.plant(x, 1.0, trees=4, leaf_points=30, k=10, recall=0.0, checks=1, least_rows=200, seed=6)
    assert round(forest.weights.sum()) == 601
    seen = {int(i) for t, leaf in forest.probe(forest.costs(x[:1]), 0) for i in forest.trees[t].points[leaf]}
    assert len(seen - set(range(300))) >= 199


def test_queries_unlike_the_rows_find_their_neighbours(spark):
    """Rows in clusters, queries away from all: a budget fitted on the rows alone finds a third of the neighbours."""
    r = np.random.default_rng(8)
    x = r.normal(size=(50, 32))[r.integers(0, 50, 6000)] * 5 + r.normal(size=(6000, 32))
    x[::100] = r.normal(size=(60, 32)) * 5
    df = spark.createDataFrame([(i, [float(v) for v in row], None) for i, row in enumerate(x)], SCHEMA)
    got = {(q.query_id, q.vec_id) for q in ann.nearest(df, df.filter("vec_id % 100 = 0"), sample_rows=1500, least_rows=0).collect()}
    want = set()
    for i in range(0, 6000, 100):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        want |= {(i, int(j)) for j in np.argsort(d)[:10]}
    assert len(got & want) >= 0.9 * len(want)


def test_top_products(spark):
    rows = vectors() + ODD + [(3, vectors()[3][1], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = lambda v: np.floor(1024 * v)
    want = brute(rows, lambda q, v: int(whole(q) @ whole(v)), True, True)
    for options in ({}, {"block_rows": 70, "block_queries": 2, "buckets": 5, "seed_rows": 30}, {"seed_rows": 3}):
        assert {tuple(r) for r in topk.top_products(df, df.filter("vec_id % 100 = 0"), **options).collect()} == want
    assert topk.top_products(df.limit(0), df).count() == 0 and topk.top_products(df, df.limit(0)).count() == 0


def test_ids_repeated_among_the_best(spark):
    """Both searches return k distinct ids, though one of the best comes more than k times."""
    r = np.random.default_rng(9)
    x = r.normal(size=(300, 16)).astype(np.float32)
    near = x[100] * np.float32(1.5)
    x[7], x[8] = near, near * np.float32(1.01)
    rows = [(i, [float(v) for v in row], None) for i, row in enumerate(x)]
    rows += [(i, [float(v) for v in x[i] * np.float32(1 + 1e-4 * n)], None) for i in (7, 8) for n in range(15)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.filter("vec_id % 100 = 0")
    whole = lambda v: np.floor(1024 * v)
    want = brute(rows, lambda q, v: int(whole(q) @ whole(v)), True, True)
    for options in ({}, {"seed_rows": 40, "buckets": 3}):
        assert {tuple(r) for r in topk.top_products(df, asked, **options).collect()} == want
    want = brute(rows, lambda q, v: float(np.sqrt(((v - q) ** 2).sum())), False, False)
    assert {tuple(r) for r in ann.nearest(df, asked).collect()} == want


def test_large_components(spark):
    df = spark.createDataFrame([(100, [1e30, -1.0], None), (1, [1e30, 2.0], None), (2, [3e12, 1.0], None), (3, [-1e30, 0.5], None)], SCHEMA)
    got = topk.top_products(df, df.filter("vec_id = 100")).collect()
    assert [r.vec_id for r in got] == [1, 2, 3] and got[0].score == 2**63 - 1


def test_pruning_keeps_what_reaches():
    r = np.random.default_rng(2)
    x = np.floor(r.normal(size=(500, 6)) * 100) + np.repeat([[400, 0, 0, 0, 0, 0], [0, 0, -400, 0, 0, 0]], 250, axis=0)
    b = topk.Bucket(np.arange(500), x)
    for q in [*x[:40], *-x[:5]]:
        for least in (-5, 1, 50_000, 150_000, 200_000, 10**9):
            reach = set(np.flatnonzero(b.x @ q >= least))
            assert reach <= set(b.candidates(q, least))
