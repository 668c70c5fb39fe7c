"""Approximate nearest neighbours: a forest of random-projection trees with one priority queue, then exact distances."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample
from tidemark.llm.vectors import best, commonest_size, distinct_best, finite, matrix

#: Queries that are compared with a bundle at once; bounds a task's memory.
_CHUNK = 128


@dataclass(frozen=True)
class Tree:
    normals: np.ndarray  # of each inner node
    offsets: np.ndarray
    children: np.ndarray  # left, right; -1 - n stands for leaf n
    points: list[np.ndarray]  # sample points in each leaf

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), 0 if len(self.normals) else -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            n = node[inner]
            right = np.einsum("ij,ij->i", x[inner], self.normals[n]) > self.offsets[n]
            node[inner] = self.children[n, right.astype(int)]
        return -1 - node


def grow(x: np.ndarray, leaf: float, r: np.random.Generator) -> Tree:
    """Splits the sample along the line between two of its points, until a leaf has ``leaf`` points. Leaves are numbered from left to right."""
    normals, offsets, children, points = [], [], [], []
    open_parts = [(np.arange(len(x)), -1, 0)]
    while open_parts:
        part, parent, side = open_parts.pop()
        at, cut = -1 - len(points), _cut(x, part, r) if len(part) > max(leaf, 1) else None
        if cut is None:
            points.append(part)
        else:
            normal, offset, right = cut
            at = len(normals)
            normals.append(normal)
            offsets.append(offset)
            children.append([0, 0])
            open_parts += [(part[right], at, 1), (part[~right], at, 0)]
        if parent >= 0:
            children[parent][side] = at
    return Tree(np.array(normals).reshape(-1, x.shape[1]), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), points)


def _cut(x: np.ndarray, part: np.ndarray, r: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray] | None:
    for _ in range(5):
        a, b = x[r.choice(part, 2, replace=False)]
        n = a - b
        if (length := np.linalg.norm(n)) > 1e-12:
            p = x[part] @ (n / length)
            cut = float((a + b) @ (n / length) / 2)
            if not 0.2 <= (p > cut).mean() <= 0.8:
                cut = float(np.median(p))
            right = p > cut
            if right.any() and not right.all():
                return n / length, cut, right
    return None


def weigh(x: np.ndarray) -> np.ndarray:
    """A weight for each sample point: copies of one vector count as one point together."""
    if not len(x):
        return np.zeros(0)
    _, at, n = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    return 1 / n[at.reshape(-1)]


def _log_normal(z: np.ndarray) -> np.ndarray:
    """Logarithm of the normal distribution function, by a logistic that is close to it; it orders leaves, no more."""
    return -np.logaddexp(0.0, -z * (1.5976 + 0.07056 * z * z))


@dataclass(frozen=True)
class Forest:
    trees: list[Tree]
    centre: np.ndarray
    follow: float  # how far a neighbour's projections follow those of a query, and how they scatter around that
    scatter: float
    weights: np.ndarray  # of the sample points
    scale: float  # rows that a sample point stands for
    budget: float  # weight of the sample points that a query visits
    points: np.ndarray  # the sample
    wanted: int  # sample points nearest to a query that it looks for, and how many of them it may miss
    missed: int

    def near(self, q: np.ndarray) -> np.ndarray:
        """The ``wanted`` sample points nearest to each query, in no order."""
        if self.wanted >= len(self.points):
            return np.tile(np.arange(len(self.points)), (len(q), 1))
        d = (self.points * self.points).sum(axis=1) - 2 * (q @ self.points.T)
        return np.argpartition(d, self.wanted, axis=1)[:, : self.wanted]

    def costs(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each tree, for each query and inner node: minus the log likelihood that a neighbour lies left of it, and right."""
        out = []
        for t in self.trees:
            middle = t.normals @ self.centre
            z = np.clip((self.follow * (q @ t.normals.T - middle) + middle - t.offsets) / self.scatter, -30, 30)
            out.append((-_log_normal(-z), -_log_normal(z)))
        return out

    def visits(self, costs: list[tuple[np.ndarray, np.ndarray]], i: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(tree, leaf, points not met before) for query ``i``, likeliest leaves first.

        All trees share one queue. A node's priority is the sum of the costs on the way to it: what a neighbour of the query
        would have to be unlikely for.
        """
        new = np.ones(len(self.weights), bool)
        heap = [(0.0, t, 0 if len(tree.normals) else -1) for t, tree in enumerate(self.trees)]
        lists = [(left[i].tolist(), right[i].tolist(), tree.children.tolist()) for (left, right), tree in zip(costs, self.trees, strict=True)]
        while heap:
            p, t, n = heapq.heappop(heap)
            if n < 0:
                points = self.trees[t].points[-1 - n]
                points = points[new[points]]
                new[points] = False
                yield t, -1 - n, points
                continue
            left, right, children = lists[t]
            heapq.heappush(heap, (p + left[n], t, children[n][0]))
            heapq.heappush(heap, (p + right[n], t, children[n][1]))

    def probe(self, costs: list[tuple[np.ndarray, np.ndarray]], i: int, near: np.ndarray | None = None) -> list[tuple[int, int]]:
        """The (tree, leaf) that query ``i`` visits, until they hold sample points of weight ``budget``, each counted once, and all but
        ``missed`` of ``near``, those nearest to the query: a query unlike the sample has neighbours where the queue does not expect them."""
        found, seen, left = [], 0.0, set() if near is None else set(near.tolist())
        for t, leaf, points in self.visits(costs, i):
            found.append((t, leaf))
            seen += self.weights[points].sum()
            if left:
                left.difference_update(points.tolist())
            if seen >= self.budget and len(left) <= self.missed:
                break
        return found


def plant(x: np.ndarray, scale: float, *, trees: int, leaf_points: int, k: int, recall: float, checks: int, least_rows: int, seed: int) -> Forest:
    """Trees on a sample, and the budget at which ``checks`` of its points find ``recall`` of their ``k`` nearest ones in it.

    The table is at least as dense as the sample, so its neighbours are nearer and likelier to be found. The budget stands for
    at least ``least_rows`` distinct rows. Beside it, each query asks for ``recall`` of its own 3 * ``k`` nearest sample points.
    """
    r = np.random.default_rng(seed)
    weights, centre = weigh(x), x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    grown = [grow(x, leaf_points, r) for _ in range(trees)]
    asked = r.permutation(len(x))[:checks]
    square = (x * x).sum(axis=1)
    near = []
    for i in asked:
        d = square - 2 * (x @ x[i])
        d[i] = np.inf
        near.append(np.argpartition(d, min(k, len(d)) - 1)[:k])
    normals = np.concatenate([t.normals for t in grown])
    if len(normals) and len(asked):
        lines = normals[r.permutation(len(normals))[:64]].T
        a, b = (((x[i] - centre) @ lines) for i in (np.repeat(asked, [len(n) for n in near]), np.concatenate(near)))
        follow = float((a * b).sum() / max((a * a).sum(), 1e-300))
        scatter = float(np.std(b - follow * a)) + 1e-12
    else:
        follow, scatter = 1.0, 1.0
    own = min(3 * k, len(x))
    made = lambda budget: Forest(grown, centre, follow, scatter, weights, scale, budget, x, own, int(own * (1 - recall)))
    forest = made(float(weights.sum()))
    # the weight that each of the neighbours needs; as much is the budget as ``recall`` of all of them need
    costs, needed = forest.costs(x[asked]), []
    for i, wanted in enumerate(near):
        seen, at = 0.0, {}
        left = set(wanted.tolist())
        for _, _, points in forest.visits(costs, i):
            seen += weights[points].sum()
            for j in left.intersection(points.tolist()):
                at[j] = seen
                left.discard(j)
            if not left:
                break
        needed += at.values()
    budget = float(np.quantile(needed, recall)) if needed else 0.0
    return made(max(budget, least_rows / scale))


@dataclass(frozen=True)
class Bundles:
    """Neighbouring leaves of a tree that meet queries together, and in how many blocks."""

    of: list[np.ndarray]  # of each tree, each leaf's bundle
    blocks: list[np.ndarray]  # of each tree, each bundle's blocks

    @classmethod
    def of_counts(cls, counts: list[np.ndarray], block_rows: int, least: int = 16) -> Bundles:
        """For the rows of each tree's leaves: bundles of up to about ``block_rows``, of which a tree has at least about ``least``."""
        of, blocks = [], []
        for rows in counts:
            each = max(1.0, min(block_rows, rows.sum() / least))
            _, number = np.unique(np.floor((np.cumsum(rows) - rows) / each), return_inverse=True)
            of.append(number)
            blocks.append(np.ceil(np.bincount(number, rows) / (2 * block_rows)).astype(np.int64).clip(1))
        return cls(of, blocks)


def nearest(
    df: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    trees: int = 8,
    leaf_points: int = 16,
    recall: float = 0.95,
    checks: int = 200,
    least_rows: int = 320,
    sample_rows: int = 20_000,
    block_rows: int = 8192,
    block_queries: int = 16_384,
    seed: int = 5,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found for each row of ``queries`` among those of ``df``.

    The trees are fitted on about ``sample_rows`` distinct vectors, drawn by a hash (the only ones that the driver sees), down to
    leaves of ``leaf_points`` of them; every row is then put in its leaf of each tree, and leaves are counted. A query visits leaves in the order in which
    its neighbours are likely to lie there, over all trees, until they hold so many distinct vectors as let ``checks`` sample points find
    ``recall`` of their neighbours: a share of the table that follows from how it clusters, at any size. A row found in several trees
    counts once in that, and copies of a vector count as one. A query goes on until it has met ``recall`` of its own 3 * ``k`` nearest
    sample points as well, so one that lies unlike the rows, away from all clusters, is served as well as they are.

    Queries and rows meet in bundles of neighbouring leaves; crowded ones are dealt over blocks of about ``block_rows``, queries
    over groups of about ``block_queries``, and a block goes only to the groups that ask for it. Each meeting keeps the k nearest
    ids. The score is the Euclidean distance in double precision.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows with a null id or another
    number of components than most. A row does not find its own id; rows that share an id count once, with the nearest. Ties
    go to the smaller id. Without rows or queries the result is empty; other columns are not read.
    """
    use = lambda x: x.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & finite("v") & F.exists("v", lambda y: y != 0))
    rows, asked = use(df), use(queries)
    d = max(1, commonest_size(rows, "v"))
    rows, asked = rows.filter(F.size("v") == d), asked.filter(F.size("v") == d)
    sample, distinct = bounded_sample(rows.select("v"), ["v"], sample_rows)
    x = np.array([r[0] for r in sample.orderBy(F.xxhash64("v"), "v").collect()], np.float64).reshape(-1, d)
    groups = max(1, ceil(asked.count() / block_queries))
    planted = plant(x, max(1.0, distinct / max(1, len(x))), trees=trees, leaf_points=leaf_points, k=k, recall=recall, checks=checks, least_rows=least_rows, seed=seed)
    spark = df.sparkSession
    sown = spark.sparkContext.broadcast(planted)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(0), d)
            for t, tree in enumerate(sown.value.trees):
                leaf, n = np.unique(tree.leaves(v), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), t), pa.int32()), pa.array(leaf, pa.int32()), pa.array(n)], names=["tree", "leaf", "n"])

    counts = [np.zeros(len(t.points)) for t in planted.trees]
    for r in rows.select("v").mapInArrow(tally, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        counts[r.tree][r.leaf] = r.n
    shared = spark.sparkContext.broadcast((planted, Bundles.of_counts(counts, block_rows)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, sets = shared.value
        for batch in batches:
            v, salt = matrix(batch.column(1), d), batch.column(2).to_numpy()
            for t, tree in enumerate(forest.trees):
                leaf = tree.leaves(v)
                bundle = sets.of[t][leaf]
                cols = [np.full(len(leaf), t), bundle, salt % sets.blocks[t][bundle], leaf]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols), batch.column(0), batch.column(1)], names=["tree", "bundle", "block", "leaf", "id", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, sets = shared.value
        for batch in (b.slice(at, _CHUNK) for b in batches for at in range(0, b.num_rows, _CHUNK)):
            q = matrix(batch.column(1), d)
            costs, near, key, wanted, at = forest.costs(q), forest.near(q), [], [], []
            for i in range(batch.num_rows):
                by_bundle: dict[tuple[int, int], list[int]] = {}
                for t, leaf in forest.probe(costs, i, near[i]):
                    by_bundle.setdefault((t, int(sets.of[t][leaf])), []).append(leaf)
                for (t, bundle), leaves in by_bundle.items():
                    for block in range(sets.blocks[t][bundle]):
                        key.append((t, bundle, block))
                        wanted.append(leaves)
                        at.append(i)
            take = pa.array(at, pa.int32())
            cols = [*(pa.array([x[c] for x in key], pa.int32()) for c in range(3)), batch.column(2).take(take), pa.array(wanted, pa.list_(pa.int32())), batch.column(0).take(take), batch.column(1).take(take)]
            yield pa.RecordBatch.from_arrays(cols, names=["tree", "bundle", "block", "group", "leaves", "id", "v"])

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [_meet(left.slice(at, _CHUNK), right, d, k) for at in range(0, left.num_rows, _CHUNK)] if left.num_rows and right.num_rows else []
        cols = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64 if c < 2 else np.float64) for c in range(3)]
        return pa.Table.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    element = dict(df.dtypes)[vector_col]
    salted = rows.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)).alias("salt"))
    placed = salted.mapInArrow(place, f"tree int, bundle int, block int, leaf int, id long, v {element}")
    grouped = asked.select("id", "v", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(groups)).cast("int").alias("group"))
    visits = grouped.mapInArrow(visit, f"tree int, bundle int, block int, group int, leaves array<int>, id long, v {element}")
    at = ["tree", "bundle", "block"]
    key = [*at, "group"]
    if groups > 1:
        needed = visits.select(*(F.col(c).alias(f"n_{c}") for c in key)).distinct()
        placed = placed.join(needed, [F.col(c) == F.col(f"n_{c}") for c in at]).withColumnRenamed("n_group", "group").select(*key, "leaf", "id", "v")
    else:
        placed = placed.withColumn("group", F.lit(0))
    found = visits.groupBy(*key).cogroup(placed.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")
    return best(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), k, F.col("score"))


def _meet(left: pa.Table, right: pa.Table, d: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest ids for each query among the rows of the leaves that it visits: an estimate picks, exact distances decide."""
    q_ids, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
    q, y = matrix(left.column("v"), d), matrix(right.column("v"), d)
    _, leaf = np.unique(leaves := right.column("leaf").to_numpy(), return_inverse=True)
    numbers = {int(n): i for i, n in enumerate(np.unique(leaves))}
    wanted = np.zeros((len(q), len(numbers)), bool)
    for i, asked in enumerate(left.column("leaves").to_pylist()):
        wanted[i, [numbers[n] for n in asked if n in numbers]] = True
    square = (y * y).sum(axis=1)
    near = square - 2 * (q @ y.T)
    near[~wanted[:, leaf] | (ids == q_ids[:, None])] = np.inf
    slack = 1e-9 * (square.max() + (q * q).sum(axis=1))
    repeats, out = len(np.unique(ids)) < len(ids), []
    for i in range(len(q)):
        if repeats or near.shape[1] <= k:
            at = np.flatnonzero(near[i] < np.inf)
        else:
            most = np.partition(near[i], k - 1)[k - 1]
            at = np.flatnonzero(near[i] <= most + slack[i]) if most < np.inf else np.flatnonzero(near[i] < np.inf)
        diff = y[at] - q[i]
        dist = np.sqrt((diff * diff).sum(axis=1))
        first = distinct_best(ids[at], -dist)[:k]
        out.append((np.full(len(first), q_ids[i]), ids[at][first], dist[first]))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3))
