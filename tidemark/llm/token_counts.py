"""Token counts of whole texts by a two-tier lookup, without a shuffle."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import some_files
from tidemark.llm.pieces import PieceCoder, coder

#: Longer pre-tokens are not kept.
_LONGEST = 64
_BUCKETS = 1 << 30


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def frequent_lengths(df: DataFrame, text_col: str, path: str, *, size: int, sample_rows: int, sample_chars: int, sample_files: int = 64) -> dict[str, int]:
    """Token counts of the ``size`` most frequent pre-tokens of a sample: of at most about ``sample_rows`` different texts, from a place in each
    that a hash tells, ``sample_chars`` characters. Both bound what the driver sees; ties go to the smaller pre-token.

    The texts come from about ``sample_files`` of the files (all, if fewer), so the sample reads no more of a larger table. Rows are counted from
    the files' footers and chosen by a hash of the text; where many are copies, the sample is smaller.
    """
    c = coder(path)
    drawn = some_files(df, sample_files)
    n, hashed = drawn.count(), F.xxhash64(text_col)
    text, length = F.col(text_col), F.char_length(text_col)
    place = F.pmod(hashed, F.greatest(length - sample_chars + 1, F.lit(1))).cast("int") + 1
    some = drawn.filter(F.pmod(F.xxhash64(text_col, F.lit(11)), F.lit(_BUCKETS)) < int(_BUCKETS * min(1.0, sample_rows / max(n, 1))))
    passages = some.filter(length > 0).select(F.substring(text, place, F.lit(sample_chars)).alias("text")).distinct()
    counts = Counter(chain.from_iterable(c.split(r.text)[1:-1] or c.split(r.text) for r in passages.collect()))
    often = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]
    return {piece: len(c.packed(piece)) // 4 for piece, _ in often if len(piece) <= _LONGEST}


class _Lengths(dict):
    """First tier: the broadcast table. Second: what this worker has met, encoded once; dropped when it grows too large."""

    def __init__(self, table: dict[str, int], c: PieceCoder, cache_size: int):
        super().__init__(table)
        self.table, self.coder, self.most = table, c, len(table) + cache_size

    def __missing__(self, piece: str) -> int:
        n = 1 if piece in self.coder.special else len(self.coder.raw(piece.encode()))
        if len(piece) <= _LONGEST:
            if len(self) >= self.most:
                self.clear()
                self.update(self.table)
            self[piece] = n
        return n


#: The lengths of the last query in this worker: they outlive its tasks.
_WORKER: dict[str, _Lengths] = {}


def worker_lengths(key: str, path: str, table: Callable[[], dict[str, int]], cache_size: int) -> _Lengths:
    """Both tiers of this worker for the query ``key``, made from ``table()`` when first asked for."""
    if key not in _WORKER:
        lengths = _Lengths(table(), coder(path), cache_size)
        _WORKER.clear()
        _WORKER[key] = lengths
    return _WORKER[key]


def count_tokens(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    limit: int = 1024,
    table_size: int = 16_384,
    cache_size: int = 200_000,
    sample_rows: int = 2000,
    sample_chars: int = 4000,
    sample_files: int = 64,
) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit) for each row of ``df``.

    The counts are the library's, without added special tokens; special strings inside a text count as it counts them.
    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids each give their own row; other columns are
    not read. An empty table gives no rows.

    The ``table_size`` pre-tokens that are most frequent in a bounded sample are broadcast with their lengths; others are encoded where
    they are met and kept by the worker, across its tasks. The sample decides how often that happens, never the counts. The plan is a
    scan and one Python evaluation: no pre-token leaves its task.
    """
    path = tokenizer or default_tokenizer()
    shared = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, text_col, path, size=table_size, sample_rows=sample_rows, sample_chars=sample_chars, sample_files=sample_files))
    key = uuid.uuid4().hex

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = worker_lengths(key, path, lambda: shared.value, cache_size)
        split, get = lengths.coder.split, lengths.__getitem__
        for texts in batches:
            yield pd.Series([sum(map(get, split(t))) for t in texts], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = df.select(F.col(id_col).alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
