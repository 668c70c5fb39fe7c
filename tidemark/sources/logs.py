"""Log files as rows (file, file_seq, lineno, line)."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def number_lines(df: DataFrame) -> DataFrame:
    """Line numbers from 1 in each file, for rows (line) of a text scan.

    Splits of a file are numbered by themselves and counted; the counts before a split, a row for each split, are joined
    back. No file is sorted in one task.
    """
    rows = df.select("line", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    split = W.partitionBy("file", "_start")
    counts = rows.groupBy("file", "_start").count()
    before = counts.select("file", "_start", F.coalesce(F.sum("count").over(W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = rows.withColumn("_n", F.row_number().over(split.orderBy("_id")))
    return local.join(before, ["file", "_start"]).select("file", (F.col("_n") + F.col("_before")).cast("long").alias("lineno"), "line")


def read_log(spark: SparkSession, *paths: str, strict: bool = False) -> DataFrame:
    """Lines of text files (.gz too), in UTF-8. Bytes that are not UTF-8 become U+FFFD, or raise if ``strict``.

    ``file_seq`` is the place of the path among the arguments.
    """
    fix = F.validate_utf8 if strict else F.make_valid_utf8
    parts = []
    for i, path in enumerate(paths):
        rows = number_lines(spark.read.text(path).withColumnRenamed("value", "line"))
        parts.append(rows.select("file", F.lit(i).alias("file_seq"), "lineno", fix("line").alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rotated(spark: SparkSession, base: str, include_gz: bool = True) -> list[str]:
    """A log and its rotated files, oldest (highest number) first. The folder is listed by Hadoop, so any store will do."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(base)
    name, found = PurePosixPath(base).name, []
    for status in fs.listStatus(path.getParent()):
        other = status.getPath().getName()
        m = re.search(r"\.(\d+)(\.gz)?$", other[len(name) :]) if other.startswith(name) else None
        if m and (include_gz or not m[2]):
            found.append((int(m[1]), status.getPath().toString()))
    return [p for _, p in sorted(found, reverse=True)] + [path.toString()]


def read_rotated(spark: SparkSession, base: str, include_gz: bool = True) -> DataFrame:
    return read_log(spark, *rotated(spark, base, include_gz))


def write_lines(df: DataFrame, path: str, col: str = "line", *, numbers: bool = False, count_only: bool = False, order: tuple[str, ...] = ("file_seq", "lineno")) -> int:
    """Lines in the given order as text files, with their places ahead of them if ``numbers``; their number is returned.

    With ``count_only`` the number alone is written. Places need a checkpoint directory.
    """
    if count_only:
        counted = df.agg(F.count("*").cast("string").alias("value"))
        counted.write.mode("overwrite").text(path)
        return int(df.sparkSession.read.text(path).first()[0])
    rows = df.select(*order, F.col(col).alias("value"))
    if numbers:
        from tidemark.functions.report import numbered as shown
        from tidemark.operators.ordered import numbered

        rows = numbered(rows, *order, name="_place").withColumn("value", shown(F.col("value"), F.col("_place")))
    written = Observation()  # above the sort, whose sampling runs what is below it twice
    rows.orderBy(*order).select("value").observe(written, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path)
    return written.get.get("n", 0)


def write_merged(df: DataFrame, path: str, *, tag: bool = False, skip_untimed: bool = False) -> int:
    """Lines of several files by time as text files, see ``ordered.merge``; their number is returned."""
    from tidemark.operators.ordered import merge

    return write_lines(merge(df, skip_untimed, tag), path, order=("rank",))


def bucket_key(line, field: str | None = None, pattern: str | None = None):
    """Where a line goes when a log is split: by a field (``unknown`` without) or by a pattern (``default`` without a hit): by its first named group, else its first group, else the whole hit."""
    from tidemark.functions.fields import field as get
    from tidemark.functions.regex import to_java
    from tidemark.functions.text import stripped

    if field is not None:
        key = F.coalesce(get(line, field), F.lit("unknown"))
    else:
        p = to_java(pattern)
        named = re.compile(pattern).groupindex
        group = min(named.values()) if named else min(1, re.compile(pattern).groups)
        key = F.when(line.rlike(p), F.regexp_extract(line, p, group)).otherwise("default")
    safe = F.regexp_replace(stripped(key), r"(?U)[^\w.\-]", "_")
    return F.when(safe == "", "unknown").otherwise(safe)


def split_log(df: DataFrame, path: str, field: str | None = None, pattern: str | None = None) -> DataFrame:
    """Appends the lines to one folder for each bucket; the counts of the buckets are returned."""
    keyed = df.withColumn("bucket", bucket_key(F.col("line"), field, pattern))
    keyed.select("bucket", F.col("line").alias("value")).write.mode("append").partitionBy("bucket").text(path)
    return keyed.groupBy("bucket").count()
