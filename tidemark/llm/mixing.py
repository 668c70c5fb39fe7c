"""Mixing sources to target weights: exact block quotas, split over shards by a tree of hypergeometric draws."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import cycle, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: ASCII white space separates words.
WORD = r"[^\x20\x09-\x0D]+"
#: What tells a row apart: rows that agree in all of it are interchangeable.
KEY = ("id", "source", "size", "print", "nth")


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = 2.0) -> list[float]:
    """Shares ``total`` by weight; what exceeds ``most`` times a source's size is shared anew among the others."""
    out, free, left = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}, float(total)
    while free:
        weight = sum(weights[i] for i in free)
        share = {i: left * weights[i] / weight for i in free}
        over = {i for i in free if share[i] > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free -= over
    return out


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """How many of ``draws`` blocks, drawn without replacement, are among the ``good`` ones: the value at ``u`` of the inverse
    distribution function.

    Probabilities follow from their ratios to that of the mode, over twelve standard deviations on either side; what lies
    beyond is less than doubles can hold. So the draw is exact to double precision for any counts.
    """
    low, high, n = max(0, draws - bad), min(good, draws), good + bad
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (n + 2)))
    spread = (draws * (good / n) * (bad / n) * ((n - draws) / max(1, n - 1))) ** 0.5
    reach = int(12 * spread) + 60
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    log = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.cumsum(np.exp(log - log.max()))
    return first + int(min(np.searchsorted(p, u * p[-1], side="right"), len(p) - 1))


def split_quotas(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Of each stratum (row), the number of blocks in each shard (column).

    A tree halves the shards; at each node the left half draws its blocks from the node's without replacement, so the counts
    are those of a multivariate hypergeometric distribution, each quota is met exactly, and shards differ by one block at most.
    """
    out = np.zeros((len(quotas), shards), np.int64)
    total = sum(map(int, quotas))
    room = np.full(shards, total // shards, np.int64) + (np.arange(shards) < total % shards)
    before = np.concatenate([[0], np.cumsum(room)])
    nodes = [(list(map(int, quotas)), 0, shards)]
    while nodes:
        counts, lo, hi = nodes.pop()
        if hi - lo == 1:
            out[:, lo] = counts
            continue
        mid = (lo + hi) // 2
        u = np.random.default_rng((seed, lo, hi)).random(len(counts))
        left, need, rest = [], int(before[mid] - before[lo]), sum(counts)
        for c, x in zip(counts, u, strict=True):
            rest -= c
            left.append(hypergeometric(c, rest, need, float(x)))
            need -= left[-1]
        nodes += [(left, lo, mid), ([c - x for c, x in zip(counts, left, strict=True)], mid, hi)]
    return out


@dataclass(frozen=True)
class Stratum:
    """One pass over one source: the blocks that it has and the words that each shard draws from it."""

    source: int
    copy: int
    starts: np.ndarray  # of the shards with any, first word in the source's permuted stream
    ends: np.ndarray
    shards: np.ndarray


def strata(sizes: Sequence[int], goals: Sequence[float], shards: int, seed: int, block_words: int = 4096, blocks: int = 2048) -> list[Stratum]:
    """Block quotas of each pass over each source, split over the shards, as words of the source's permuted stream.

    A source's stream is cut in blocks of ``block_words`` words, or fewer where it would have less than ``blocks`` of them. It is
    passed over whole as often as its goal permits, and once more for the quota of the rest. A pass's blocks are cut in one
    run for each shard, in proportion to what ``split_quotas`` gives it, and the shard draws that many from the front of its own run:
    no block is drawn twice in a pass, and the split decides which are. The last block of the last shard is cut, so that the words
    of a source are its rounded goal; a pass that is not whole leaves out the stream's last block if that is short.
    """
    passes = []  # source, copy, words a block, blocks to draw from, quota, words wanted
    for i, (s, goal) in enumerate(zip(sizes, goals, strict=True)):
        if s:
            each = max(1, min(block_words, s // blocks))
            n, want = -(-s // each), round(goal)
            passes += [(i, c, each, n, n, s) for c in range(want // s)]
            if rest := want % s:
                quota = -(-rest // each)
                passes.append((i, want // s, each, max(quota, n - 1), quota, rest))
    out = []
    for (i, c, each, n, quota, want), row in zip(passes, split_quotas([p[4] for p in passes], shards, seed), strict=True):
        some = np.flatnonzero(row)
        before = [int(x) for x in (np.cumsum(row) - row)[some]]
        starts = np.array([b * n // quota for b in before], np.int64)
        ends = np.minimum((starts + row[some]) * each, sizes[i])
        starts *= each
        ends[-1] -= (ends - starts).sum() - want
        out.append(Stratum(i, c, starts, ends, some))
    return out


class Mix:
    """What ``mix`` returns, all DataFrames: ``rows`` (id, source, size, print, nth), ``sources`` (source, source_size, target)
    and ``pieces`` (the columns of ``rows``, copy, shard, begin, taken, position)."""

    def __init__(self, rows: DataFrame, sources: DataFrame, pieces: DataFrame):
        self.rows, self.sources, self.pieces = rows, sources, pieces


def _words(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def sized(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (id, source, size, print, times): what the draws look at, with the number of rows that agree in all of it."""
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _words(text_col).alias("size"), F.xxhash64(text_col).alias("print"))
    return rows.groupBy("id", "source", "size", "print").agg(F.count("*").alias("times"))


def mix(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 4096,
    shard_words: int = 1 << 24,
    least_shards: int = 16,
    cell_rows: int = 1024,
    seed: int = 2024,
) -> Mix:
    """Draws a mixture of all rows of ``df``.

    * Sources in code point order (null last) have the weights in turn; ``targets`` are in words.
    * A source's rows are permuted by a hash of the seed, the id and the text; their words in that order are the source's stream.
      Running sums come from cells of the hash of about ``cell_rows`` rows, so no source is ordered in one task.
    * ``strata`` splits the exact quotas of the stream's blocks over the shards, one for each ``shard_words`` words of the
      mixture and ``least_shards`` at least; each shard takes its blocks of every source and orders the pieces at random.

    ``pieces`` has one row for each run of words of a row that a shard takes in one pass (``copy``): its first word ``begin``
    (from 0), the words ``taken``, and its ``position`` in the shard. The words taken of a source are its rounded target.

    Every choice hangs on hashes of the seed and the row alone, so reruns give the same mixture, whatever the partitions. A null
    text counts as empty; empty texts and sources without words have no pieces, nor has an empty table. Rows that agree in id,
    source and text are told apart by a number; null ids and sources are values like any other. The driver sees one row for
    each source, and the table of sources by shards is broadcast to the tasks: 24 bytes an entry. Texts are read once; the light rows
    are written to the checkpoint folder.
    """
    spark = df.sparkSession
    light = sized(df, id_col=id_col, text_col=text_col, source_col=source_col).checkpoint()
    found = light.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("words"), F.sum("times").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    sizes = [int(r.words) for r in found]
    goal = targets(sizes, list(islice(cycle(weights), len(found))), share * sum(sizes), most)
    kind = light.schema["source"].dataType
    fields = [T.StructField("source", kind), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]
    sources = spark.createDataFrame([(r.source, s, t) for r, s, t in zip(found, sizes, goal, strict=True)], T.StructType(fields))
    rows = light.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")

    plan = strata(sizes, goal, max(least_shards, -(-round(sum(goal)) // shard_words)), seed, block_words)
    shared = spark.sparkContext.broadcast(plan)
    cells = T.StructType([T.StructField("_source", kind), T.StructField("_number", T.IntegerType()), T.StructField("_cells", T.LongType())])
    numbers = spark.createDataFrame([(r.source, i, max(1, r.n // cell_rows)) for i, r in enumerate(found)], cells)
    used = rows.filter("size > 0").join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    used = used.withColumn("_h", F.xxhash64("id", "print", "nth", F.lit(seed)))
    # cells are ranges of the hash, so that their order is that of the permutation
    used = used.withColumn("_cell", F.floor(F.shiftrightunsigned("_h", 33) * F.col("_cells") / F.lit(float(1 << 31))).cast("long")).drop("_cells")
    order = (F.shiftrightunsigned("_h", 33), "_h", *KEY)
    inside = W.partitionBy("_number", "_cell").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("_number").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    sums = used.groupBy("_number", "_cell").agg(F.sum("size").alias("_w"))
    sums = sums.select("_number", "_cell", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_before"))
    placed = used.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["_number", "_cell"])
    stream = placed.select(*KEY, "_number", (F.col("_in") + F.col("_before")).alias("_at"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, at, size = (batch.column(i).to_numpy() for i in (len(KEY), len(KEY) + 1, KEY.index("size")))
            for s in shared.value:
                own = np.flatnonzero(number == s.source)
                a, b = at[own], at[own] + size[own]
                first, last = np.searchsorted(s.ends, a, side="right"), np.searchsorted(s.starts, b, side="left")
                n = np.maximum(0, last - first)
                row = np.repeat(np.arange(len(own)), n)
                j = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                lo, hi = np.maximum(s.starts[j], a[row]), np.minimum(s.ends[j], b[row])
                kept = batch.select(list(KEY)).take(pa.array(own[row]))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.full(len(row), s.copy), pa.int32()), pa.array(s.shards[j], pa.int32()), pa.array(lo - a[row]), pa.array(hi - lo)], names=out.names)

    extra = [("copy", T.IntegerType()), ("shard", T.IntegerType()), ("begin", T.LongType()), ("taken", T.LongType())]
    out = T.StructType([*(rows.schema[k] for k in KEY), *(T.StructField(n, t) for n, t in extra)])
    pieces = stream.mapInArrow(take, out)
    local = W.partitionBy("shard").orderBy(F.xxhash64("id", "print", "nth", "copy", "begin", F.lit(seed + 1)), *KEY, "copy", "begin")
    return Mix(rows, sources, pieces.withColumn("position", (F.row_number().over(local) - 1).cast("long")))


def _same(left: Sequence[str], right: Sequence[str]) -> F.Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out &= F.col(a).eqNullSafe(F.col(b))
    return out


def taken_words(result: Mix) -> DataFrame:
    """Rows (id, size, source_size, target, taken, shard, position), one for each row mixed.

    ``taken`` is 0 where the mixture has nothing of the row; ``shard`` and ``position`` tell where its first piece stands and
    are null then.
    """
    first = F.min(F.struct("copy", "begin", "shard", "position")).alias("_first")
    got = result.pieces.groupBy(*KEY).agg(F.sum("taken").alias("taken"), first)
    got = got.select(*(F.col(k).alias(f"t_{k}") for k in KEY), "taken", "_first")
    all_rows = result.rows.join(got, _same(KEY, [f"t_{k}" for k in KEY]), "left")
    sources = result.sources.select(F.col("source").alias("s_source"), "source_size", "target")
    joined = all_rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s_source")))
    return joined.select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.col("_first.shard").alias("shard"), F.col("_first.position").alias("position"))


def mixed_texts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture as rows of ``df``, in the order of its shards and of the places in them.

    A row comes for each piece of its text that a shard takes: the text as it is where the piece is all of it, else its words joined by
    spaces. All columns stay; of rows that agree in id, source and text, those of one stand for all. Nulls, empty texts and
    tables are as ``mix`` says.
    """
    result = mix(df, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    pieces = result.pieces.select(*(F.col(k).alias(f"_{k}") for k in ("id", "source", "print", "size")), "begin", "taken", "shard", "position")
    pieces = pieces.select(*pieces.columns[:4], *(F.col(c).alias(f"_{c}") for c in pieces.columns[4:]))
    texts = df.filter(F.col(text_col).isNotNull()).withColumn("_text_print", F.xxhash64(text_col)).dropDuplicates(list(dict.fromkeys([id_col, source_col, "_text_print"])))
    joined = texts.join(pieces, _same([id_col, source_col, "_text_print"], ["_id", "_source", "_print"]))
    words = F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), (F.col("_begin") + 1).cast("int"), F.col("_taken").cast("int"))
    text = F.when(F.col("_taken") == F.col("_size"), F.col(text_col)).otherwise(F.array_join(words, " "))
    ordered = joined.withColumn(text_col, text).repartitionByRange("_shard", "_position").sortWithinPartitions("_shard", "_position")
    return ordered.select(*df.columns)
