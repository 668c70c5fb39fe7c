"""Filters, counts and groupings of lines. All take and give rows with file, lineno and line, unless stated."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import fields as fl
from tidemark.functions import levels, timestamps
from tidemark.functions.once import let
from tidemark.functions.order import Key, keyed
from tidemark.functions.regex import to_java
from tidemark.functions.text import detect_format, stripped, typed_json


def time_range(df: DataFrame, start: datetime | None = None, end: datetime | None = None, keep_untimed: bool = False) -> DataFrame:
    """Lines between both times, inclusive. Empty lines go; lines without a time go unless ``keep_untimed``."""
    ts = timestamps.extract(F.col("line"))
    inside = ts.isNotNull()
    if start is not None:
        inside &= ts >= F.lit(start).cast("timestamp_ntz")
    if end is not None:
        inside &= ts <= F.lit(end).cast("timestamp_ntz")
    return df.filter((F.col("line") != "") & (inside | (ts.isNull() & F.lit(keep_untimed))))


def last_window(df: DataFrame, seconds: float, anchor: datetime) -> DataFrame:
    """Lines of the ``seconds`` before the anchor, both ends inclusive; lines without a time stay."""
    if seconds <= 0:
        raise ValueError("seconds must be positive")
    ts = timestamps.extract(F.col("line"))
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in (anchor - timedelta(seconds=seconds), anchor))
    return df.filter(ts.isNull() | ts.between(lo, hi))


def grep(df: DataFrame, pattern: str, invert: bool = False, ignore_case: bool = False, fixed: bool = False) -> DataFrame:
    hit = F.col("line").contains(pattern) if fixed and not ignore_case else F.col("line").rlike(to_java(pattern, ignore_case, fixed))
    return df.filter(~hit if invert else hit)


def field_equals(df: DataFrame, name: str, value: str, ignore_case: bool = False) -> DataFrame:
    v = fl.field(F.col("line"), name)
    return df.filter(F.lower(v) == value.lower() if ignore_case else v == value)


def level_range(df: DataFrame, least: str, most: str | None = None) -> DataFrame:
    """Lines with a level of at least ``least``; an unknown least keeps all that have one, an unknown most none."""
    s = levels.severity_of(levels.extract(F.col("line")))
    keep = (s >= 0) & (s >= levels.severity(least))
    return df.filter(keep if most is None else keep & (s <= levels.severity(most)))


def every(df: DataFrame, n: int) -> DataFrame:
    if n < 1:
        raise ValueError("n must be positive")
    return df.filter(F.col("lineno") % n == 0)


def fraction(df: DataFrame, p: float, seed: int = 0) -> DataFrame:
    """Each line with probability ``p``, by a hash of seed, file and number: the same lines for any partitioning and in every run."""
    if not 0 <= p <= 1:
        raise ValueError("a probability lies between 0 and 1")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("file", F.lit("")), F.col("lineno").cast("string"))), 1, 13), 16, 10).cast("long")
    return df.filter(draw < F.lit(int(p * (1 << 52))))


def head(df: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` lines of each file."""
    return df.filter(F.col("lineno") <= n)


def from_line(df: DataFrame, line: int) -> DataFrame:
    """What follows the first ``line`` lines of each file, as a bookmark on that line reads it."""
    return df.filter(F.col("lineno") > line)


def clip(df: DataFrame, start: int, end: int | None = None) -> DataFrame:
    if start < 1 or end is not None and end < start:
        raise ValueError("a range of lines starts at 1 and does not end before its start")
    return df.filter(F.col("lineno") >= start if end is None else F.col("lineno").between(start, end))


def tail(df: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` lines of each file."""
    last = W.partitionBy("file").orderBy(F.desc("lineno"))
    return df.withColumn("_last", F.row_number().over(last)).filter(F.col("_last") <= max(0, n)).drop("_last")


def count_field(df: DataFrame, name: str) -> DataFrame:
    """Lines by the value of a field; a JSON null counts as ``None``."""
    line, js = F.col("line"), fl.from_json(F.col("line"))
    value = F.when(js.isNotNull() & F.map_contains_key(js, F.lit(name)), F.coalesce(F.try_element_at(js, F.lit(name)), F.lit("None"))).when(js.isNull(), F.try_element_at(fl.from_pairs(line, "greedy"), F.lit(name)))
    return df.select(value.alias("value")).filter("value is not null").groupBy("value").count()


def count_pattern(df: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """All hits by their first group, or by the whole hit where the pattern has none or it took no part."""
    import re

    p, groups = to_java(pattern, ignore_case), re.compile(pattern).groups
    hits = F.regexp_extract_all("line", F.lit(p), F.lit(0))
    if groups:
        # an empty first group that took part is told by one more: its reference matches then, and the hit's last character is taken
        flags, body = p[: p.index(")") + 1], p[p.index(")") + 1 :]
        p = F.lit(f"{flags}(?:{body})(?:(?=\\1)(?<=([\\s\\S])))?")
        found = F.arrays_zip(hits.alias("hit"), F.regexp_extract_all("line", p, F.lit(1)).alias("first"), F.regexp_extract_all("line", p, F.lit(groups + 1)).alias("took"))
        hits = F.transform(found, lambda x: F.when((x["first"] != "") | (x["took"] != ""), x["first"]).otherwise(x["hit"]))
    return df.select(F.explode(hits).alias("value")).groupBy("value").count()


def count_lines(df: DataFrame) -> DataFrame:
    return df.select(stripped(F.col("line")).alias("value")).filter("value <> ''").groupBy("value").count()


def top(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest of counted values (value, count), ties in the order of the values."""
    return counts.orderBy(F.desc("count"), "value").limit(max(0, n))


def frequency(df: DataFrame, name: str | None = None, top: int | None = None) -> DataFrame:
    """Lines or values of a field by count, ties by first appearance; ``pct`` is of the rows returned."""
    v = F.col("line") if name is None else fl.field(F.col("line"), name, "tokens")
    out = df.select(v.alias("value"), "lineno").filter("value is not null").groupBy("value").agg(F.count("*").alias("count"), F.min("lineno").alias("first"))
    if top is not None:
        out = out.orderBy(F.desc("count"), "first").limit(top)
        # a few rows, so their sum is a window over them
        total = F.sum("count").over(W.partitionBy())
        return out.select("value", "count", "first", (F.col("count") * 100 / total).alias("pct"))
    # without a cut the percentages need the number of all lines that have a value
    total = df.agg(F.count(v).alias("_total"))
    return out.crossJoin(F.broadcast(total)).select("value", "count", "first", (F.col("count") * 100 / F.col("_total")).alias("pct"))


def pivot(df: DataFrame, key: str, value: str) -> DataFrame:
    """For each key: lines, sum of the values that are numbers, and that sum over all its lines."""
    line = F.col("line")
    raw = F.trim(fl.field(line, value))
    parsed = F.when(raw.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), raw.try_cast("double"))
    out = df.select(fl.field(line, key).alias("key"), parsed.alias("v")).filter("key is not null").groupBy("key").agg(F.count("*").alias("count"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum"))
    return out.withColumn("mean", F.col("sum") / F.col("count"))


def rate(df: DataFrame, seconds: int = 60) -> DataFrame:
    """Lines by window of time, with lines a second; lines without a time are left out, empty windows too."""
    ts = timestamps.extract(F.col("line"))
    out = df.select(F.window(ts, f"{seconds} seconds").alias("w")).groupBy("w").count()
    return out.select(F.col("w.start").alias("bucket"), "count", (F.col("count") / seconds).alias("per_second"))


def stats(df: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: lines, matched lines, counts of levels, and first and last time in order of lines."""
    m = matched.select("lineno", timestamps.extract(F.col("line")).alias("ts"), levels.counted(F.col("line")).alias("level"))
    by_level = m.filter("level is not null").groupBy("level").count().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "count")))).alias("level_counts"))
    place = F.when(F.col("ts").isNotNull(), F.col("lineno"))
    ends = m.agg(F.count("*").alias("matched_lines"), F.min_by("ts", place).alias("first_timestamp"), F.max_by("ts", place).alias("last_timestamp"))
    return df.agg(F.count("*").alias("total_lines")).crossJoin(ends).crossJoin(by_level)


def score(df: DataFrame, weights: dict[str, float], threshold: float = 0.0, top: int | None = None) -> DataFrame:
    """The sum of the weights of the patterns found in a line, each once, case apart; ties by line."""
    hits = {p: F.col("line").rlike(to_java(p, True)) for p in weights}
    total = sum((F.when(h, float(weights[p])).otherwise(0.0) for p, h in hits.items()), F.lit(0.0))
    out = df.withColumn("score", total).withColumn("matched", F.array_compact(F.array(*(F.when(h, p) for p, h in hits.items())))).filter(F.col("score") >= threshold)
    return out.orderBy(F.desc("score"), "lineno").limit(top) if top is not None else out


def time_order(reverse: bool = False) -> list[Key | Column]:
    """Untimed lines after the others, by text. One key holds all, so that a line's time is looked for once."""
    key = let(timestamps.extract(F.col("line")), lambda ts: F.struct(ts.isNull().alias("untimed"), ts.alias("ts"), F.when(ts.isNull(), F.col("line")).alias("line")))
    return [Key(key, reverse), F.col("lineno")]


def sort_time(df: DataFrame, reverse: bool = False) -> DataFrame:
    """By time; lines without one come last, by text. Reversed, all of it turns but the order of equals."""
    return _sorted(df, time_order(reverse))


def _sorted(df: DataFrame, order: list[Key | Column]) -> DataFrame:
    rows, by = keyed(df, order)
    return rows.orderBy(*by).select(*df.columns)


def field_order(name: str, reverse: bool = False, numeric: bool = False) -> list[Key | Column]:
    """Order by a field: lines without it first, then JSON numbers by value, then text. If ``numeric``, text is read as numbers too."""
    line = F.col("line")
    v = F.coalesce(fl.field(line, name), F.lit(""))
    if numeric:
        return [Key(v.try_cast("double"), reverse), F.col("lineno")]
    kind = F.schema_of_variant(F.try_element_at(typed_json(line), F.lit(name)))
    number = F.coalesce(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    # one key holds all, so that a line is parsed once; whole numbers that are one double are told apart by the third
    parts = lambda p: F.struct(
        F.when(p["v"] == "", 0).when(p["number"], 1).otherwise(2).alias("kind"),
        F.when(p["number"], p["v"].try_cast("double")).alias("number"),
        F.when(p["number"], p["v"].try_cast("decimal(38,0)")).alias("whole"),
        F.when(~p["number"], p["v"]).alias("text"),
    )
    return [Key(let(F.struct(v.alias("v"), number.alias("number")), parts), reverse), F.col("lineno")]


def sort_field(df: DataFrame, name: str, reverse: bool = False, numeric: bool = False) -> DataFrame:
    return _sorted(df, field_order(name, reverse, numeric))


def vote_format(df: DataFrame, sample: int = 20) -> DataFrame:
    """The commonest format among the first ``sample`` lines that are not blank, ties by first appearance."""
    first = df.filter(stripped(F.col("line")) != "").orderBy("lineno").limit(sample).select("lineno", detect_format(F.col("line")).alias("format")).filter("format is not null")
    return first.groupBy("format").agg(F.count("*").alias("votes"), F.min("lineno").alias("first")).orderBy(F.desc("votes"), "first").limit(1).select("format", "votes")


def vote_formats(df: DataFrame, sample: int = 20) -> DataFrame:
    """Rows (file, format, votes): the commonest format among the first ``sample`` lines of each file, blank ones among them, ties
    by first appearance. A file without any has no row. Only lines of these numbers are read on."""
    found = df.filter(F.col("lineno") <= sample).select("file", "lineno", detect_format(F.col("line")).alias("format")).filter("format is not null")
    votes = found.groupBy("file", "format").agg(F.count("*").alias("votes"), F.min("lineno").alias("first"))
    return votes.groupBy("file").agg(F.max_by(F.struct("format", "votes"), F.struct("votes", -F.col("first"))).alias("best")).select("file", "best.*")
