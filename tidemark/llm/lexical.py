"""Ranked lexical search: WAND over shards of documents, and the shards' heaps merged.

One scan of the texts builds the index: a row for each shard, with the postings of those terms that any item asks for, the documents'
lengths and their ids, documents in order of id. Document frequencies and lengths are summed from it. Each shard is then
searched by itself for every item: cursors stand on the postings of the item's terms, and from the greatest impact that each term has in
the shard follows the pivot, the first document that could beat the worst of the best k; all cursors ahead of it skip
there. Only the heaps, k rows an item and shard, are shuffled.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import stored
from tidemark.llm.importance import pieces

#: Bytes of terms: digits, letters (A-Z become lower case), all beyond ASCII; the rest ends a term.
TERMS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_INDEX = "docs long, length long, ids array<long>, sizes array<long>, terms array<int>, starts array<long>, postings array<int>, times array<long>"
_NAMES = [f.split()[0] for f in _INDEX.split(", ")]


def counts(text: bytes, known: dict[bytes, int]) -> tuple[int, Counter]:
    """The number of a text's terms, and how often each known one occurs."""
    n, found = 0, Counter()
    for words in pieces(text, TERMS):
        n += len(words)
        found.update(map(known.get, words))
    found.pop(None, None)
    return n, found


def _index(docs: DataFrame, known: dict[bytes, int], shard_docs: int, shard_bytes: int) -> DataFrame:
    """A row for each shard: its documents with terms, their terms in all, and of those that hold a known term ids, sizes and postings."""

    def pack(held: list[tuple], n_docs: int, length: int) -> pa.RecordBatch:
        held.sort(key=lambda d: (d[0] is None, d[0] or 0))
        by_term: dict[int, tuple[list[int], list[int]]] = {}
        for i, (_, _, found) in enumerate(held):
            for t, times in found.items():
                at, tf = by_term.setdefault(t, ([], []))
                at.append(i)
                tf.append(times)
        terms = sorted(by_term)
        flat = lambda k: np.concatenate([np.array(by_term[t][k], np.int64) for t in terms]) if terms else np.zeros(0, np.int64)
        starts = np.cumsum([0, *(len(by_term[t][0]) for t in terms)])
        lists = [
            pa.array([[d[0] for d in held]], pa.list_(pa.int64())), pa.array([[d[1] for d in held]], pa.list_(pa.int64())), pa.array([terms], pa.list_(pa.int32())),
            pa.array([starts], pa.list_(pa.int64())), pa.array([flat(0).astype(np.int32)], pa.list_(pa.int32())), pa.array([flat(1)], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([length], pa.int64()), *lists], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_docs = length = read = 0
        for batch in batches:
            for id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                data = text.as_py()
                n, found = counts(data, known)
                read += len(data)
                if n:
                    n_docs, length = n_docs + 1, length + n
                if found:
                    held.append((id, n, found))
                if len(held) >= shard_docs or read >= shard_bytes:
                    yield pack(held, n_docs, length)
                    held, n_docs, length, read = [], 0, 0, 0
        if n_docs:
            yield pack(held, n_docs, length)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, _INDEX), "lexical")


def wand(cursors: list[tuple[int, int, list[int], list[int]]], k: int) -> list[tuple[int, int]]:
    """The best ``k`` documents as (score, document), of equal ones the first, from cursors (factor, greatest impact, documents, impacts)."""
    heap: list[tuple[int, int]] = []
    least = 0  # a document must have more to come in
    # state of a cursor: [document, number]; sorted by document
    order = sorted([c[2][0], i] for i, c in enumerate(cursors))
    factor, bound = [c[0] for c in cursors], [c[0] * c[1] for c in cursors]
    docs, impacts, at = [c[2] for c in cursors], [c[3] for c in cursors], [0] * len(cursors)
    total = sum(bound)
    while total > least:
        reach, p = 0, 0
        for p, (_, i) in enumerate(order):  # noqa: B007
            reach += bound[i]
            if reach > least:
                break
        pivot, over = order[p][0], []
        if order[0][0] == pivot:
            score = 0
            for place, (d, i) in enumerate(order):
                if d != pivot:
                    break
                j = at[i]
                score += factor[i] * impacts[i][j]
                at[i] = j = j + 1
                if j < len(docs[i]):
                    order[place][0] = docs[i][j]
                else:
                    over.append(place)
            if score > least:
                if len(heap) < k:
                    heappush(heap, (score, -pivot))
                else:
                    heapreplace(heap, (score, -pivot))
                if len(heap) == k:
                    least = heap[0][0]
        else:
            for place in range(p):
                d, i = order[place]
                if d < pivot:
                    at[i] = j = bisect_left(docs[i], pivot, at[i] + 1)
                    if j < len(docs[i]):
                        order[place][0] = docs[i][j]
                    else:
                        over.append(place)
        for place in reversed(over):
            total -= bound[order[place][1]]
            del order[place]
        order.sort()
    return [(s, -d) for s, d in heap]


def _search(index: DataFrame, asked: list[tuple[int, list[tuple[int, int]]]], weight: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """Rows (item, doc_id, score): the heaps of all shards. asked: (item, its terms as (number, occurrences))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, terms, starts, postings, times = (batch.column(c)[row].values for c in _NAMES[2:])
                ids = ids.to_pylist()
                m = 25 + 75 * sizes.to_numpy() * n_docs // length
                starts, postings, times = starts.to_numpy(), postings.to_numpy(), times.to_numpy()
                lists = {}
                for t, a, b in zip(terms.to_pylist(), starts[:-1], starts[1:], strict=True):
                    impact = 1_000_000_000 * times[a:b] // (1000 * times[a:b] + 8 * m[postings[a:b]])
                    lists[t] = (int(impact.max()), postings[a:b].tolist(), impact.tolist())
                out: list[list] = [[], [], []]
                for item, wanted in asked:
                    cursors = [(q * int(weight[t]), *lists[t]) for t, q in wanted if t in lists and weight[t] > 0]
                    for score, d in wand(cursors, k) if cursors else ():
                        for col, v in zip(out, (item, ids[d], score), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def _best(found: DataFrame, k: int, salt: int = 64) -> DataFrame:
    """The best ``k`` of each item with their ranks; first in ``salt`` parts of its rows, so that no task gets all shards' heaps of one item."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    part = found.withColumn("_part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(salt)))
    near = part.withColumn("_r", F.row_number().over(W.partitionBy("item", "_part").orderBy(*order))).filter(F.col("_r") <= k)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = 10,
    shard_docs: int = 32_768,
    shard_bytes: int = 64 << 20,
    pass_bytes: int = 8 << 20,
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): of each item (item_id, text) the best ``k`` of ``docs`` (doc_id, text) with a score above 0.

    A term's weight falls with the documents that hold it, its impact grows with its occurrences and falls with the document's
    length (BM25 in whole numbers); an item's repeated terms count each time. Equal scores rank by ascending doc_id, null ids last.

    A null text, or one without terms, is found by nothing and finds nothing. Rows of one doc_id are documents of their own. Items
    are told apart by id, null being one: texts of one id ask together, an item's equal rows ask once. Texts of any length are read
    whole. With an empty table on either side the result is empty. Further columns are left out.

    Items' terms and postings bounds go to all tasks; items are taken in passes of about ``pass_bytes`` of text, so that this is
    bounded. A shard's row holds the postings of ``shard_docs`` documents or ``shard_bytes`` of text. Needs the shared checkpoint folder.
    """
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // pass_bytes) or 1
    out = None
    for i in range(passes):
        some = texts.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i) if passes > 1 else texts
        one = _pass(docs, some, k, shard_docs, shard_bytes)
        out = one if out is None else out.unionByName(one)
    return out


def _pass(docs: DataFrame, texts: DataFrame, k: int, shard_docs: int, shard_bytes: int) -> DataFrame:
    names: list[int | None] = []
    terms: list[Counter] = []
    number: dict[int | None, int] = {}
    known: dict[bytes, int] = {}
    for r in texts.select("item_id", F.col("text").cast("binary").alias("text")).collect():  # bounded by pass_bytes
        if r.item_id not in number:
            number[r.item_id] = len(names)
            names.append(r.item_id)
            terms.append(Counter())
        for words in pieces(bytes(r.text), TERMS):
            terms[number[r.item_id]].update(known.setdefault(w, len(known)) for w in words)
    asked = [(i, sorted(c.items())) for i, c in enumerate(terms) if c]
    index = _index(docs, known, shard_docs, shard_bytes)
    n_docs, length = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    holders = F.explode(F.arrays_zip("terms", F.transform("terms", lambda t, i: F.element_at("starts", i + 2) - F.element_at("starts", i + 1)).alias("n")))
    weight = np.zeros(len(known), np.int64)
    for r in index.select(holders.alias("t")).groupBy("t.terms").agg(F.sum("t.n").alias("n")).collect():  # one row a known term at most
        weight[r.terms] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.n + 1)))
    best = _best(_search(index, asked, weight, n_docs, length, k), k)
    labels = docs.sparkSession.createDataFrame([(i, names[i]) for i, _ in asked], "item long, item_id long")
    return best.join(F.broadcast(labels), "item").select("item_id", "rank", "doc_id", "score")
