"""Byte-level BPE encoding and decoding, with long texts encoded in halves by many tasks and joined exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.pieces import Encoded, coder, join_tree
from tidemark.llm.token_counts import default_tokenizer

#: Rows that are turned into one Arrow batch; bounds the memory of a worker.
_ROWS = 1024


def encode(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    part_chars: int = 32_768,
) -> DataFrame:
    """Rows (id, ids array<int>, decoded string): token ids of each whole text, and what they decode to.

    Texts of up to ``part_chars`` characters are encoded where they are read. Longer ones are halved until the parts are
    short enough; the parts are dealt out over all tasks, encoded there, and joined pairwise: a growing window around each
    join is encoded anew until both sides agree. The result equals encoding the whole text at once. The encoding is what takes
    time and is shared out; a join costs its window, and the task that joins a text holds its parts as arrays, a few bytes for
    each character, as it must hold the row that it returns.

    A null text counts as empty and gives no ids and an empty text. Repeated rows each give a row, rows with a null id
    too, but copies of a long text under one id are encoded once; other columns are not read.
    """
    path = tokenizer or default_tokenizer()
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    long = F.char_length("_text") > part_chars
    kind = df.schema[id_col].dataType
    done = T.StructType([T.StructField("_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    short = rows.filter(~long).mapInArrow(_encode_whole(path, done), done)
    # copies of a long text under one id are encoded once
    prints = (F.xxhash64("_text").alias("_hash"), F.xxhash64("_text", F.lit(1)).alias("_more"))
    whole = rows.filter(long).groupBy("_id", *prints).agg(F.first("_text").alias("_text"), F.count("*").alias("_copies"))
    key = [T.StructField("_id", kind), T.StructField("_hash", T.LongType()), T.StructField("_more", T.LongType()), T.StructField("_copies", T.LongType())]
    parts = T.StructType([*key, T.StructField("_part", T.IntegerType()), T.StructField("_text", T.StringType())])
    dealt = whole.select("_id", "_hash", "_more", "_copies", "_text").mapInArrow(_halve(part_chars, parts), parts).repartition("_id", "_hash", "_part")
    coded = T.StructType([*parts.fields, *(T.StructField(c, T.BinaryType()) for c in ("_ends", "_cuts", "_ids"))])
    joined_type = T.StructType([*done.fields, T.StructField("_copies", T.LongType())])
    joined = dealt.mapInArrow(_encode_parts(path, coded), coded).groupBy("_id", "_hash", "_more").applyInArrow(_join_parts(path, joined_type), joined_type)
    joined = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*done.names)
    return short.unionByName(joined).withColumnRenamed("_id", id_col)


def _list_array(lists: list[np.ndarray]) -> pa.Array:
    """int32 lists as Arrow, with no Python objects between."""
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))


def _encode_whole(path: str, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                lists = [c.ids(t) for t in part.column(1).to_pylist()]
                decoded = pa.array([c.decode(x.tolist()) for x in lists], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), _list_array(lists), decoded], names=schema.names)

    return run


def _halve(part_chars: int, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(4).to_pylist()):
                n = 1
                while len(text) > n * part_chars:
                    n *= 2
                cuts = [len(text) * k // n for k in range(n + 1)]
                for k in range(n):
                    cols = [*batch.slice(i, 1).columns[:4], pa.array([k], pa.int32()), pa.array([text[cuts[k] : cuts[k + 1]]], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return run


def _encode_parts(path: str, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for i in range(batch.num_rows):
                [(_, *data)] = Encoded.of(c, batch.column(5)[i].as_py()).runs
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *(pa.array([x.tobytes()], pa.binary()) for x in data)], names=schema.names)

    return run


def _join_parts(path: str, schema: T.StructType):
    def run(group: pa.Table) -> pa.Table:
        c = coder(path)
        order = np.argsort(group.column("_part").to_numpy(), kind="stable")
        columns = [group.column(n) for n in ("_text", "_ends", "_cuts", "_ids")]
        parts = [Encoded([(columns[0][int(i)].as_py(), *(np.frombuffer(x[int(i)].as_py(), np.int32) for x in columns[1:]))]) for i in order]
        ids = join_tree(c, parts).ids
        first = group.slice(0, 1)
        found = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))
        cols = [first.column("_id").combine_chunks(), found, pa.array([c.decode(ids.tolist())], pa.string()), first.column("_copies").combine_chunks()]
        return pa.Table.from_arrays(cols, names=schema.names)

    return run
