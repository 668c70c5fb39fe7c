"""Reading parts of large text files: byte ranges, an index of splits, and the last lines.

Files lie on a path that every machine can open. A range holds the lines that begin in it, so ranges that meet share no line and
lose none.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import timestamps
from tidemark.operators.carried import micros

RANGE = "file string, begin long, end long, first_line long"
INDEX = "file string, begin long, end long, first_line long, lines long, least_us long, greatest_us long, untimed long"


def read_ranges(ranges: DataFrame, batch: int = 10_000) -> DataFrame:
    """Rows (file, begin, offset, lineno, line) of all lines that begin in the ranges (file, begin, end, first_line).

    ``lineno`` counts on from a range's ``first_line``. Each range is read by itself and a batch of lines at a time.
    """
    names = ["file", "begin", "offset", "lineno", "line"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def lines(file: str, begin: int, end: int, number: int) -> Iterator[tuple]:
        with open(file, "rb") as f:
            at = begin
            if begin:  # from the byte before, so that a line that begins with the range is its own
                f.seek(begin - 1)
                at += len(f.readline()) - 1
            while at < end and (line := f.readline()):
                yield file, begin, at, number, line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
                at, number = at + len(line), number + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for r in b.to_pylist():
                for row in lines(r["file"], r["begin"], r["end"], r["first_line"]):
                    held.append(row)
                    if len(held) >= batch:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return ranges.select("file", "begin", "end", "first_line").mapInArrow(run, "file string, begin long, offset long, lineno long, line string")


def _dealt(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Ranges, one a task as far as there are not very many."""
    return spark.createDataFrame(rows, RANGE).repartition(max(1, min(len(rows), 10_000)))


# -- an index of splits ---------------------------------------------------------------------------------------------------


def build_index(spark: SparkSession, *files: str, split_bytes: int = 64 << 20) -> DataFrame:
    """One row for each split of ``split_bytes`` of each file: its bytes, first line and lines, the least and greatest time in it, and how
    many of its lines have none. To be kept as Parquet beside the log; it holds for the bytes that were there."""
    ranges = [(f, a, min(a + split_bytes, size), 1) for f in files for size in [os.path.getsize(f)] for a in range(0, size, split_bytes)]
    us = micros(timestamps.extract(F.col("line")))
    per = read_ranges(_dealt(spark, ranges)).groupBy("file", "begin").agg(F.count("*").alias("lines"), F.min(us).alias("least_us"), F.max(us).alias("greatest_us"), F.count_if(us.isNull()).alias("untimed"))
    before = F.coalesce(F.sum("lines").over(W.partitionBy("file").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = spark.createDataFrame(ranges, RANGE).select("file", "begin", "end")
    return per.join(ends, ["file", "begin"]).withColumn("first_line", before + 1).select(*(c.split()[0] for c in INDEX.split(", ")))


def splits(index: DataFrame, first: int | None = None, last: int | None = None, start: datetime | None = None, end: datetime | None = None, keep_untimed: bool = False) -> DataFrame:
    """The splits that may hold lines ``first`` to ``last``, and times from ``start`` to ``end``, or untimed lines if those are kept too.

    Times need not be in order: a split is told by the least and greatest of its own.
    """
    keep = F.lit(True)
    if first is not None:
        keep &= F.col("first_line") + F.col("lines") > first
    if last is not None:
        keep &= F.col("first_line") <= last
    if start is not None or end is not None:
        at = lambda t: micros(F.lit(t).cast("timestamp_ntz"))
        inside = F.col("least_us").isNotNull()
        if start is not None:
            inside &= F.col("greatest_us") >= at(start)
        if end is not None:
            inside &= F.col("least_us") <= at(end)
        keep &= inside | (F.col("untimed") > 0 if keep_untimed else F.lit(False))
    return index.filter(keep)


def read_indexed(index: DataFrame, first: int | None = None, last: int | None = None, start: datetime | None = None, end: datetime | None = None, keep_untimed: bool = False) -> DataFrame:
    """Rows (file, lineno, line) of the lines ``first`` to ``last`` with times from ``start`` to ``end``, reading only splits that may hold some.

    The same rows as ``rows.clip`` and ``rows.time_range`` give of the whole log.
    """
    from tidemark.operators import rows

    some = splits(index, first, last, start, end, keep_untimed)
    tasks = max(1, min(some.count(), 10_000))
    out = read_ranges(some.repartition(tasks)).select("file", "lineno", "line")
    if first is not None or last is not None:
        out = rows.clip(out, first or 1, last)
    return rows.time_range(out, start, end, keep_untimed) if start is not None or end is not None else out


# -- the last lines -------------------------------------------------------------------------------------------------------


def tail_start(path: str, n: int, block: int = 1 << 16) -> tuple[int, int, int]:
    """Where the last ``n`` lines begin, where the last whole line ends, and how many bytes were read to find out.

    Blocks are read from the end on until they hold enough line feeds; a last line without one counts as a line.
    """
    with open(path, "rb") as f:
        size = at = f.seek(0, os.SEEK_END)
        feeds, read, whole = 0, 0, None
        want = n  # line feeds ahead of the first line wanted, its own predecessor's included
        while at and n > 0:
            begin = max(0, at - block)
            f.seek(begin)
            data = f.read(at - begin)
            read += len(data)
            stop = len(data)
            while (found := data.rfind(b"\n", 0, stop)) >= 0:
                if whole is None:
                    whole = begin + found + 1
                    want += whole == size  # the file's last line feed ends a line, and begins none
                feeds += 1
                if feeds == want:
                    return begin + found + 1, whole, read
                stop = found
            at = begin
        return (0 if n > 0 else size), (size if n <= 0 else whole or 0), read


def tail(spark: SparkSession, path: str, n: int = 10, range_bytes: int = 64 << 20) -> DataFrame:
    """Rows (file, offset, line) of the last ``n`` lines of a file; no more of it is read than they take, and a block."""
    begin, _, _ = tail_start(path, n)
    size = os.path.getsize(path)
    return _read(spark, path, begin, size, range_bytes)


def _read(spark: SparkSession, path: str, begin: int, end: int, range_bytes: int) -> DataFrame:
    return read_ranges(_dealt(spark, [(path, a, min(a + range_bytes, end), 1) for a in range(begin, end, range_bytes)])).select("file", "offset", "line")


def tail_then_follow(spark: SparkSession, path: str, n: int = 10, range_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """The last ``n`` whole lines of a file (fewer by the one still being written), and the stream of all that follows them."""
    from tidemark.streaming.follow import follow

    begin, whole, _ = tail_start(path, n)
    return _read(spark, path, begin, whole, range_bytes), follow(spark, path, start=whole)
