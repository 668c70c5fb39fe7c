"""A sink that deals lines out to one series of files for each bucket, in one pass.

Tasks write files of their own; only those that the commit names are given their place, so a task that ran twice leaves no line twice.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tidemark.sources.logs import bucket_key


@dataclass
class _Written(WriterCommitMessage):
    first: tuple  # of its rows' order, so that files of a bucket are numbered in order
    files: dict[str, tuple[str, int]]


class _Writer(DataSourceArrowWriter):
    """Rows (bucket, seq, lineno, line), sorted. Options: path, prefix, suffix, job."""

    def __init__(self, options: dict):
        self.path, self.prefix, self.suffix = options["path"], options.get("prefix", "split"), options.get("suffix", ".log")
        self.work = os.path.join(self.path, f"_writing-{options['job']}")
        self.counts = os.path.join(self.path, f"_counts-{options['job']}.json")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        own, files, first = os.path.join(self.work, uuid.uuid4().hex), {}, None
        for batch in iterator:
            buckets, lines = batch.column("bucket").to_pylist(), batch.column("line").to_pylist()
            if first is None and batch.num_rows:
                first = (buckets[0], batch.column("seq")[0].as_py(), batch.column("lineno")[0].as_py())
            at = 0
            while at < len(buckets):  # rows are sorted by bucket: one file is open at a time
                end = at
                while end < len(buckets) and buckets[end] == buckets[at]:
                    end += 1
                os.makedirs(own, exist_ok=True)
                name, n = files.get(buckets[at]) or (os.path.join(own, str(len(files))), 0)
                with open(name, "ab") as f:
                    f.write(b"".join((x or "").encode() + b"\n" for x in lines[at:end]))
                files[buckets[at]] = (name, n + end - at)
                at = end
        return _Written(first or (), files)

    def place(self, bucket: str, number: int) -> str:
        return os.path.join(self.path, f"{self.prefix}_{bucket}{'' if number == 0 else f'.{number}'}{self.suffix}")

    def commit(self, messages) -> None:
        counts: dict[str, int] = {}
        number: dict[str, int] = {}
        for m in sorted((m for m in messages if m is not None and m.files), key=lambda m: m.first):
            for bucket, (name, n) in sorted(m.files.items()):
                k = number.get(bucket, 0)
                while os.path.exists(to := self.place(bucket, k)):  # an earlier job's stay; its series goes on
                    k += 1
                os.rename(name, to)
                number[bucket], counts[bucket] = k + 1, counts.get(bucket, 0) + n
        with open(self.counts, "w", encoding="utf-8") as f:
            json.dump(counts, f)
        shutil.rmtree(self.work, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.work, ignore_errors=True)


class FanOutSink(DataSource):
    """Options: path (on a folder that all machines share), prefix (split), suffix (.log), job (tells writes apart)."""

    @classmethod
    def name(cls) -> str:
        return "fanout"

    def schema(self) -> str:
        return "bucket string, seq long, lineno long, line string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def fan_out(df: DataFrame, path: str, field: str | None = None, pattern: str | None = None, *, prefix: str = "split", suffix: str = ".log") -> dict[str, int]:
    """Writes lines (file_seq, lineno, line) to ``path/prefix_BUCKET.suffix``, and returns the lines of each bucket.

    Rows are dealt out in ranges of bucket and order, so a large bucket is many tasks' work; its files are prefix_BUCKET.suffix,
    prefix_BUCKET.1.suffix and so on, in the order of its lines. Counts come from the commit; nothing is read again.
    """
    spark, job = df.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(FanOutSink)
    os.makedirs(path, exist_ok=True)
    seq = F.col("file_seq").cast("long") if "file_seq" in df.columns else F.lit(0).cast("long")
    rows = df.select(bucket_key(F.col("line"), field, pattern).alias("bucket"), seq.alias("seq"), F.col("lineno").cast("long").alias("lineno"), "line")
    rows = rows.repartitionByRange("bucket", "seq", "lineno").sortWithinPartitions("bucket", "seq", "lineno")
    rows.write.format("fanout").options(path=path, prefix=prefix, suffix=suffix, job=job).mode("append").save()
    told = os.path.join(path, f"_counts-{job}.json")
    with open(told, encoding="utf-8") as f:
        counts = json.load(f)
    os.remove(told)
    return counts
