"""Lines as tables: aligned fields, columns with a header, flat JSON, chunks with headings, reports as text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import fields as fl
from tidemark.functions import report
from tidemark.functions.once import let


def _cells(line: Column, keys: list[str], dialect: str, missing: str, skip_plain: bool) -> Column:
    """The values of ``keys`` as an array; for a line without any field null if ``skip_plain``, else all missing."""

    def use(p: Column) -> Column:
        cells = F.array(*(F.coalesce(F.when(p["json"].isNotNull() & F.map_contains_key(p["json"], F.lit(k)), F.coalesce(fl.value(p, k, dialect), F.lit("None"))), fl.value(p, k, dialect), F.lit(missing)) for k in keys))
        has = F.coalesce(F.size(p["json"]) > 0, F.lit(False)) | (F.size(p["keys"]) > 0)
        return F.when(has | p["json"].isNotNull(), cells) if skip_plain else cells

    return let(fl.parsed(line, dialect), use)


def widths(df: DataFrame, cells: str, n: int) -> DataFrame:
    """One row: the width of each column, by a single aggregation."""
    return df.agg(F.array(*(F.coalesce(F.max(F.length(F.col(cells)[i])), F.lit(0)) for i in range(n))).alias("_widths"))


def _padded(cells: Column, least: list[int], separator: str) -> Column:
    wide = [F.greatest(F.col("_widths")[i], F.lit(w)) for i, w in enumerate(least)]
    return F.concat_ws(separator, *(F.rpad(cells[i], wide[i], " ") for i in range(len(least))))


def align(df: DataFrame, keys: list[str], separator: str = "  ", missing: str = "-") -> DataFrame:
    """``df`` with the fields ``keys`` of each line in columns as wide as their widest value (and name); lines without fields stay.

    Widths are one aggregated row, broadcast. Null lines stay null; an empty table stays empty.
    """
    rows = df.withColumn("_cells", _cells(F.col("line"), keys, "tokens", missing, True))
    out = rows.crossJoin(F.broadcast(widths(rows, "_cells", len(keys))))
    text = _padded(F.col("_cells"), [len(k) for k in keys], separator)
    return out.withColumn("line", F.when(F.col("_cells").isNotNull(), text).otherwise(F.col("line"))).select(*df.columns)


def columns(df: DataFrame, keys: list[str], separator: str = "  ", missing: str = "-", header: bool = True) -> DataFrame:
    """Rows (file, lineno, line): the fields ``keys`` of every line as a table. With ``header`` the names in upper case come first,
    as line 0 of each file. Trailing blanks go. An empty table has no header either.
    """
    rows = df.select("file", "lineno", _cells(F.col("line"), keys, "greedy", missing, False).alias("_cells"))
    names = [k.upper() for k in keys]
    wide = widths(rows, "_cells", len(keys))
    if header:
        head = rows.select("file").distinct().select("file", F.lit(0).cast("long").alias("lineno"), F.array(*map(F.lit, names)).alias("_cells"))
        rows = rows.unionByName(head)
    text = F.rtrim(_padded(F.col("_cells"), [len(n) if header else 0 for n in names], separator))
    return rows.crossJoin(F.broadcast(wide)).select("file", "lineno", text.alias("line"))


def _flat(found: dict, sep: str) -> dict:
    """Nested objects under paths of their keys; of lists, the places. Later values of a path win, at its first place."""
    out: dict = {}
    left = [(k, v) for k, v in reversed(found.items())]
    while left:
        path, v = left.pop()
        if isinstance(v, dict):
            left += [(f"{path}{sep}{k}" if path else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            # an item of a list that is a list itself stays as it is
            left += [(f"{path}{sep}{i}", x if isinstance(x, dict) else _Whole(x)) for i, x in reversed(list(enumerate(v)))]
        else:
            out[path] = v.value if isinstance(v, _Whole) else v
    return out


class _Whole:
    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value


def flatten(line: Column, sep: str = ".") -> Column:
    """A JSON object with nested values under dotted paths; any other line stays. Depth is known only from each line, so this is
    an Arrow batch function; null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lines in batches:
            yield pd.Series([_flat_line(x, sep) for x in lines], dtype="object")

    return run(line)


def _flat_line(line: str | None, sep: str) -> str | None:
    if not line or "{" not in line:
        return line
    try:
        found = json.loads(line)
    except (ValueError, RecursionError):
        return line
    return json.dumps(_flat(found, sep), ensure_ascii=False) if isinstance(found, dict) else line


def chunk_lines(df: DataFrame, prefix: str = "chunk") -> DataFrame:
    """Rows (file, chunk, lineno, line) of chunked lines with a heading ahead of each chunk, as its line 0; chunks count from 1.

    ``df`` has a column ``chunk`` from 0, as ``chunk_count`` and ``chunk_seconds`` give it.
    """
    rows = df.select("file", (F.col("chunk") + 1).cast("long").alias("chunk"), "lineno", "line")
    heads = rows.select("file", "chunk").distinct()
    heading = F.concat(F.lit(f"--- {prefix} "), F.col("chunk").cast("string"), F.lit(" ---"))
    return rows.unionByName(heads.select("file", "chunk", F.lit(0).cast("long").alias("lineno"), heading.alias("line")))


def frequency_lines(freq: DataFrame) -> DataFrame:
    """Rows (place, line) of a frequency table as ``rows.frequency`` gives it with ``top``: one line each, commonest first."""
    all_ = W.partitionBy()
    place = F.row_number().over(W.orderBy(F.desc("count"), "first")).cast("long")
    return freq.select(place.alias("place"), report.frequency(F.col("value"), F.col("count"), F.max("count").over(all_), F.sum("count").over(all_)).alias("line"))


def stats_lines(stats: DataFrame) -> DataFrame:
    """Rows (place, line): the summary text of ``rows.stats``."""
    text = report.stats(F.col("total_lines"), F.col("matched_lines"), F.col("first_timestamp"), F.col("last_timestamp"), F.col("level_counts"))
    return stats.select(F.posexplode(text).alias("place", "line")).select((F.col("place") + 1).cast("long").alias("place"), "line")


def pivot_lines(pivot: DataFrame, with_value: bool = True) -> DataFrame:
    """Rows (key, line) of a pivot as text, in order of keys after two heading lines with the keys ``""`` and null."""
    if with_value:
        line = report.pivot(F.col("key"), F.col("count"), F.col("sum"), F.col("mean"))
    else:
        line = report.pivot(F.col("key"), F.col("count"))
    head, rule = report.pivot_header(with_value)
    top = pivot.sparkSession.createDataFrame([(0, None, head), (1, None, rule)], "part int, key string, line string")
    return top.unionByName(pivot.select(F.lit(2).alias("part"), "key", line.alias("line")))


def context_lines(df: DataFrame, show_lineno: bool = False, separator: str = "--") -> DataFrame:
    """Rows (file, lineno, part, line): the text of a context search (``ordered.context``), a separator (part 0) ahead of each line (part 1)
    after a gap, but for the first line of a file's text."""
    first = df.groupBy("file").agg(F.min("lineno").alias("_first"))
    gap = F.col("gap") & (F.col("lineno") > F.col("_first"))
    parts = df.join(first, "file").select("file", "lineno", report.context(F.col("line"), F.col("lineno"), gap, show_lineno, separator).alias("parts"))
    return parts.select("file", "lineno", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "line")).select("file", "lineno", (F.col("i") + 2 - F.col("n")).alias("part"), "line")


def diff_lines(df: DataFrame, only: str | None = None, colour: bool = False) -> DataFrame:
    """Rows (side, lineno_left, lineno_right, line): a comparison (``ordered.diff``) as text, of one side if ``only`` names it."""
    if only is not None:
        if only not in report.SIDES:
            raise ValueError(f"not a side: {only}")
        df = df.filter(F.col("side") == only)
    return df.select("side", "lineno_left", "lineno_right", report.diff(F.col("side"), F.col("text"), colour).alias("line"))
