"""Operators that look at neighbouring lines.

A file may be far larger than a task, so no window spans a file. Lines are cut in blocks of ``block`` lines; a window runs
within a block, and what crosses its edge is either copied in (a few lines on either side) or carried as one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import timestamps
from tidemark.functions.order import Key, keyed
from tidemark.functions.regex import to_java
from tidemark.functions.text import rstripped
from tidemark.operators.carried import BLOCK, _rounds, blocks, chunk_seconds, compact_json, dedupe_cached, micros  # noqa: F401


def _with_neighbours(df: DataFrame, before: int, after: int, block: int) -> DataFrame:
    """Each block with up to ``before`` lines ahead of it and ``after`` behind it; ``_own`` marks its own lines."""
    reach = max(before, after)
    block = max(block, reach, 1)
    n = F.floor((F.col("lineno") - 1) / block).cast("long")
    at = (F.col("lineno") - 1) % block
    homes = F.array_compact(F.array(n, F.when(at >= block - before, n + 1) if before else F.lit(None).cast("long"), F.when((at < after) & (n > 0), n - 1) if after else F.lit(None).cast("long")))
    return df.withColumn("_home", n).withColumn("_block", F.explode(homes)).withColumn("_own", F.col("_block") == F.col("_home"))


def context(df: DataFrame, pattern: str, before: int = 0, after: int = 0, invert: bool = False, block: int = BLOCK) -> DataFrame:
    """Matching lines with their neighbours, each once; ``is_match`` tells them apart. ``gap`` marks a line after a gap."""
    hit = F.col("line").rlike(to_java(pattern))
    rows = _with_neighbours(df, after, before, block).withColumn("is_match", ~hit if invert else hit)
    near = W.partitionBy("file", "_block").orderBy("lineno").rowsBetween(-after, before)
    kept = rows.withColumn("_near", F.max("is_match").over(near)).filter("_own and _near").select("file", "lineno", "line", "is_match")
    before_it = _with_neighbours(kept, 1, 0, block)
    last = F.lag("lineno").over(W.partitionBy("file", "_block").orderBy("lineno"))
    return before_it.withColumn("gap", F.coalesce(F.col("lineno") - last > 1, F.col("lineno") > 1)).filter("_own").select("file", "lineno", "line", "is_match", "gap")


def dedupe_adjacent(df: DataFrame, block: int = BLOCK) -> DataFrame:
    rows = _with_neighbours(df, 1, 0, block)
    last = F.lag("line").over(W.partitionBy("file", "_block").orderBy("lineno"))
    return rows.withColumn("_same", last.eqNullSafe(F.col("line")) & last.isNotNull()).filter("_own and not _same").select(*df.columns)


def unique(df: DataFrame, key: Column, ignore_case: bool = False) -> DataFrame:
    """The first line of each key; lines without one stay. The first is found by an aggregation, so a hot key is combined early."""
    rows = df.withColumn("_key", F.lower(key) if ignore_case else key)
    first = rows.filter("_key is not null").groupBy("_key").agg(F.min(F.struct("file", "lineno", *(c for c in df.columns if c not in ("file", "lineno")))).alias("r")).select("r.*")
    return first.select(*df.columns).unionByName(rows.filter("_key is null").select(*df.columns))


def unique_values(df: DataFrame, value: Column, ignore_case: bool = False) -> DataFrame:
    rows = df.select(value.alias("value"), "lineno").filter("value is not null")
    return rows.groupBy((F.lower("value") if ignore_case else F.col("value")).alias("_k")).agg(F.min_by("value", "lineno").alias("value"), F.min("lineno").alias("first")).drop("_k")


def squash(df: DataFrame, min_repeat: int = 2, block: int = BLOCK) -> DataFrame:
    """Runs of lines that are equal but for numbers. A run of ``min_repeat`` or more becomes its first line with a note.

    Rows (file, lineno, line, repeated). Islands are numbered within a block and by the islands of the blocks before.
    """
    sig = F.regexp_replace("line", r"(?U)\b\d+\b", "#")
    rows = _with_neighbours(df.withColumn("_sig", sig), 1, 0, block)
    local = W.partitionBy("file", "_block").orderBy("lineno")
    rows = rows.withColumn("_new", F.when(F.lag("_sig").over(local).eqNullSafe(F.col("_sig")), 0).otherwise(1)).filter("_own")
    starts = rows.groupBy("file", "_block").agg(F.sum("_new").alias("_n"))
    starts = starts.select("file", "_block", F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_i", F.sum("_new").over(local)).join(starts, ["file", "_block"]).withColumn("_island", F.col("_i") + F.col("_before"))
    runs = rows.groupBy("file", "_island").agg(F.min(F.struct("lineno", "line")).alias("first"), F.count("*").alias("n"))
    whole = runs.filter(F.col("n") >= min_repeat).select("file", "first.lineno", F.concat("first.line", F.lit("  [repeated "), "n", F.lit("x]")).alias("line"), F.col("n").alias("repeated"))
    short = rows.join(runs.filter(F.col("n") < min_repeat).select("file", "_island"), ["file", "_island"], "left_semi")
    return whole.unionByName(short.select("file", "lineno", "line", F.lit(1).cast("long").alias("repeated")))


def _last_time(df: DataFrame, block: int) -> DataFrame:
    """``ts``, and the last time ahead of each line as ``_last``."""
    rows = blocks(df.withColumn("ts", timestamps.extract(F.col("line"))), block)
    per = rows.groupBy("file", "_block").agg(F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("lineno"))).alias("_v"))
    carry = per.select("file", "_block", F.last("_v", True).over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))
    local = W.partitionBy("file", "_block").orderBy("lineno").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_near", F.last("ts", True).over(local)).join(carry, ["file", "_block"]).withColumn("_last", F.coalesce("_near", "_carry"))


def annotate(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Milliseconds since the first and since the last line that has a time; null for lines without one."""
    ms = lambda a, b: (micros(F.col(a)) - micros(F.col(b))) / 1000.0
    rows = _last_time(df, block)
    first = rows.filter("ts is not null").groupBy("file").agg(F.min_by("ts", "lineno").alias("_first"))
    out = rows.join(F.broadcast(first), "file", "left")
    return out.select("file", "lineno", "line", ms("ts", "_first").alias("elapsed_ms"), ms("ts", "_last").alias("delta_ms"))


def byte_limit(df: DataFrame, most: int, cut: bool = False, block: int = BLOCK) -> DataFrame:
    """The first lines whose UTF-8 bytes, a line feed each included, fit in ``most``; ``cut`` adds what fits of the next line."""
    rows = blocks(df, block)
    sums = rows.groupBy("file", "_block").agg(F.sum(F.octet_length("line") + 1).alias("_v"))
    sums = sums.select("file", "_block", F.coalesce(F.sum("_v").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_carry"))
    until = F.sum(F.octet_length("line") + 1).over(W.partitionBy("file", "_block").orderBy("lineno"))
    rows = rows.join(sums.filter(F.col("_carry") < most), ["file", "_block"]).withColumn("_end", F.col("_carry") + until)
    start = F.col("_end") - F.octet_length("line") - 1
    if not cut:
        return rows.filter(F.col("_end") <= most).select(*df.columns)
    part = F.when(F.col("_end") <= most, F.col("line")).otherwise(F.make_valid_utf8(F.substring(F.encode("line", "UTF-8"), F.lit(1), (F.lit(most) - start).cast("int")).cast("string")))
    return rows.filter(start < most).withColumn("line", part).select(*df.columns)


def chunk_count(df: DataFrame, size: int) -> DataFrame:
    if size < 1:
        raise ValueError("size must be positive")
    return df.withColumn("chunk", F.floor((F.col("lineno") - 1) / size).cast("long"))


def merge(df: DataFrame, skip_untimed: bool = False, tag: bool = False, block: int = BLOCK) -> DataFrame:
    """Rows (file, lineno, line, ets, rank): lines of several files by time, ``rank`` being the place among all, from 1.

    A line without a time has that of the line before it, and ahead of any time comes first, or goes if ``skip_untimed``. A file
    out of order keeps its own order: its lines wait for the latest time ahead of them. With ``tag`` the name of the file,
    without its folders, stands before each line. Needs a checkpoint directory.
    """
    rows = _last_time(df, block).withColumn("ets", F.coalesce("ts", "_last"))
    if skip_untimed:
        rows = rows.filter("ets is not null")
    key = F.struct(F.col("ets").isNotNull().alias("timed"), "ets", "lineno", "file")
    top = rows.groupBy("file", "_block").agg(F.max(key).alias("_v"))
    top = top.select("file", "_block", F.max("_v").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_top"))
    running = F.max(key).over(W.partitionBy("file", "_block").orderBy("lineno"))
    rows = rows.drop("_carry").join(top, ["file", "_block"]).withColumn("_key", F.greatest(running, "_top"))
    line = F.concat(F.element_at(F.split("file", "/"), -1), F.lit(": "), "line") if tag else F.col("line")
    return numbered(rows.select("file", "lineno", line.alias("line"), "ets", "_key"), "_key", "file", "lineno").drop("_key")


def numbered(df: DataFrame, *order: Key | Column | str, name: str = "rank") -> DataFrame:
    """``df`` with the place of each row, from 1, in the order given. It must be total. Needs a checkpoint directory.

    Rows are sorted in ranges, each counts its own, and the counts of the ranges before it, a row for each, are joined back.
    """
    keyed_rows, by = keyed(df, order)
    # the upper bits of the id are the range, the lower 33 the place in it; written, so that both uses see the same ranges
    rows = _rounds(df.sparkSession)(keyed_rows.orderBy(*by).select(*df.columns, F.monotonically_increasing_id().alias("_at")))
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    counts = rows.groupBy("_range").count()
    before = counts.select("_range", F.coalesce(F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return rows.join(F.broadcast(before), "_range").select(*df.columns, place.cast("long").alias(name))


def diff(left: DataFrame, right: DataFrame, key: Column | None = None, ignore_timestamps: bool = False) -> DataFrame:
    """Rows (side, lineno_left, lineno_right, text). Of equal right lines the last is the partner of all equal left ones; the
    others count as right. Lines are compared without white space at their end, and by what follows their time if ``ignore_timestamps``."""
    bare = rstripped(F.col("line"))
    k = key if key is not None else timestamps.after(bare) if ignore_timestamps else bare
    a = left.select(k.alias("_k"), F.col("lineno").alias("lineno_left"), bare.alias("text"))
    b = right.select(k.alias("_k"), F.col("lineno").alias("lineno_right"), bare.alias("text"))
    last = b.groupBy("_k").agg(F.max("lineno_right").alias("lineno_right"))
    both = a.join(last, "_k", "left")
    side = F.when(F.col("lineno_right").isNull(), "left").otherwise("both")
    used = last.join(a.select("_k").distinct(), "_k", "left_semi").select("lineno_right")
    rest = b.join(used, "lineno_right", "left_anti").select(F.lit("right").alias("side"), F.lit(None).cast("long").alias("lineno_left"), "lineno_right", "text")
    return both.select(side.alias("side"), "lineno_left", "lineno_right", "text").unionByName(rest)
