"""Importance resampling: the documents whose n-grams look most like those of a target, drawn without replacement.

A document's weight is the sum, over its runs of 1 to ``most_words`` words, of the gain of each run's hash bucket: how much more often
the bucket occurs in the target than in the collection. Gumbel noise from a hash of the id is added, and the highest sums are
drawn, so that the draw follows the weights and is the same in every run.

Texts are read twice: once for the collection's bucket counts (a vector a task, summed), once for the weights. Words never leave
their tasks. The draw is by rank without a sort of all rows: an exact histogram of the integer scores, summed from
the top, gives every score the number of documents above it; the score at which the quota is met is the cutoff, and only documents
from there on are numbered, each score by itself.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import stored

#: Bytes of words: digits, lower-case letters, all beyond ASCII; A-Z become lower case, the rest ends a word.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Bytes of a text that are split into words at a time.
_PIECE = 1 << 22


def pieces(text: bytes, table: bytes, size: int = _PIECE) -> Iterator[list[bytes]]:
    """The words of a text under ``table`` (what is not in a word maps to a blank), in lists of bounded size that cut no word."""
    if len(text) <= size:
        yield text.translate(table).split()
        return
    text, at = text.translate(table), 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _hashes(text: bytes, most_words: int) -> Iterator[np.ndarray]:
    """crc32 of all runs of 1 to ``most_words`` words, the words joined by a blank; first of all the single words."""
    before: list[bytes] = []
    for words in pieces(text, _WORDS):
        runs = list(map(crc32, words))
        yield np.array(runs, np.uint32)
        # a run's hash continues that of the run without its last word
        joined = before + words
        tails = [b" " + w for w in joined]
        runs = [*map(crc32, before), *runs]
        for n in range(2, most_words + 1):
            runs = list(map(crc32, tails[n - 1 :], runs))
            # runs that end in an earlier piece were counted there
            yield np.array(runs[max(0, len(before) - n + 1) :], np.uint32)
        before = joined[-(most_words - 1) :] if most_words > 1 else []


def bucket_counts(texts: DataFrame, buckets: int, most_words: int) -> np.ndarray:
    """How often each bucket occurs in all rows of ``texts``, a frame of one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    for h in _hashes(text.as_py(), most_words):
                        total += np.bincount(h % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    name = texts.columns[0]
    per = texts.select(F.col(name).cast("binary").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in per.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r.bucket] = r.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * the logarithm of the buckets' smoothed shares in the target over those in the collection)."""
    every, wanted = int(own.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(every + len(own)) / (float(s + 1) * float(wanted + len(own))))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def noise(id: int | None, seed: int) -> int:
    """floor(1000 * a Gumbel variate) from the id's hash; a null id hashes as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, most_words: int, seed: int) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score), one for each row of ``docs``."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            ids = batch.column("doc_id").to_pylist()
            for id, text in zip(ids, batch.column("text"), strict=True):
                words = features = weight = 0
                if text.is_valid:
                    for i, h in enumerate(_hashes(text.as_py(), most_words)):
                        words += 0 if i % most_words else len(h)
                        features += len(h)
                        weight += int(gain[h % buckets].sum())
                for col, v in zip(out, (words, features, weight, weight + noise(id, seed)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in out)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def offsets(scores: DataFrame, coarse: int = 1 << 12) -> DataFrame:
    """Rows (score, n, above): how many rows have each score, and how many a higher one.

    Counts are summed from the top in two steps, over blocks of ``coarse`` neighbouring scores and then in each block, so no
    task gets more than one row for each block or for each score of a block.
    """
    block = F.floor(F.col("score") / coarse).cast("long")
    each = scores.groupBy("score").agg(F.count("*").alias("n")).withColumn("_block", block)
    blocks = each.groupBy("_block").agg(F.sum("n").alias("_n"))
    higher = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_n").over(higher(W.orderBy(F.desc("_block")))), F.lit(0)).alias("_over"))
    inside = F.coalesce(F.sum("n").over(higher(W.partitionBy("_block").orderBy(F.desc("score")))), F.lit(0))
    return each.withColumn("_in", inside).join(blocks, "_block").select("score", "n", (F.col("_over") + F.col("_in")).alias("above"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    per_cent: int = 5,
    least_words: int = 20,
    buckets: int = 10_000,
    most_words: int = 3,
    seed: int = 42,
) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank), one for each row of ``docs`` (doc_id, text); ``target`` has a column text.

    Of the N documents of ``least_words`` words or more, floor(per_cent * N / 100) are drawn, those of the highest scores, ties to
    the smaller id (null ids last, then by features and weight); ``rank`` counts them from 1 and is null for the rest.

    A null or empty text has no features and weight 0. Rows of one id are documents of their own with the same noise. Texts of
    any length are read whole, a few MB of words at a time. With an empty ``docs`` the result is empty; with an empty
    ``target`` all gains compare with an even spread. Further columns are left out. Only bucket counts (``buckets`` numbers) and the
    quota and cutoff reach the driver. Needs the shared checkpoint folder.
    """
    if most_words < 1 or buckets < 1:
        raise ValueError("runs have one word at least, and there is one bucket at least")
    gain = gains(bucket_counts(docs.select("text"), buckets, most_words), bucket_counts(target.select("text"), buckets, most_words))
    rows = stored(weighted(docs, gain, most_words, seed), "resample")
    fit = F.col("n_words") >= least_words
    quota = per_cent * rows.filter(fit).count() // 100
    above = stored(offsets(rows.filter(fit).select("score")), "resample-ranks")
    # the lowest score of which any is drawn
    cutoff = above.filter(F.col("above") < quota).agg(F.min("score")).first()[0]
    cols = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if cutoff is None:
        return rows.select(*cols, none)
    high = fit & (F.col("score") >= cutoff)
    order = W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    ranks = above.filter(F.col("score") >= cutoff).select("score", "above")
    placed = rows.filter(high).select(*cols).join(ranks, "score").withColumn("_place", F.col("above") + F.row_number().over(order))
    drawn = placed.select(*cols, F.when(F.col("_place") <= quota, F.col("_place")).cast("long").alias("rank"))
    return drawn.unionByName(rows.filter(~high).select(*cols, none))
