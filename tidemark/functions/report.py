"""Results as lines of text, as expressions over the rows that the operators return."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import rstripped

#: How sides of a comparison are marked and coloured.
SIDES = {"left": "< ", "right": "> ", "both": "  "}
SIDE_COLOURS = {"left": "\x1b[31m", "right": "\x1b[32m", "both": "\x1b[0m"}


def fixed(value: Column, width: int, places: int) -> Column:
    """A number with ``places`` decimals, padded on the left. Rounded from the exact binary value, half to even; the JVM's formatter
    rounds the shortest decimal form instead."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else f"{v:{width}.{places}f}" for v in values], dtype="object")

    return run(value.cast("double"))


def numbered(line: Column, lineno: Column) -> Column:
    """A line with its number, as the text sink shows it."""
    return F.format_string("%6d: %s", lineno, line)


def frequency(value: Column, count: Column, most: Column, total: Column) -> Column:
    """Count, per cent of the total and value; counts are padded to the width of the largest."""
    per_cent = F.when(total > 0, count / total * 100).otherwise(0.0)
    return F.concat(F.lpad(count.cast("string"), F.length(most.cast("string")), F.lit(" ")), F.lit("  "), fixed(per_cent, 5, 1), F.lit("%  "), value)


def count(value: Column, count_: Column) -> Column:
    return F.concat_ws("\t", count_.cast("string"), value)


def rate(bucket: Column, count_: Column, seconds: int, label: str = "events") -> Column:
    head = F.format_string(f"%s  %6d {label.replace('%', '%%')}  (", F.date_format(bucket, "yyyy-MM-dd HH:mm:ss"), count_)
    return F.concat(head, fixed(count_ / F.lit(seconds), 0, 2), F.lit("/s)"))


def pivot_header(with_value: bool) -> list[str]:
    """The two lines above a pivot table."""
    head = f"{'KEY':<30}  {'COUNT':>8}" + (f"  {'SUM':>12}  {'MEAN':>12}" if with_value else "")
    return [head, "-" * len(head)]


def pivot(key: Column, count_: Column, sum_: Column | None = None, mean: Column | None = None) -> Column:
    row = F.format_string("%-30s  %8d", key, count_)
    return row if sum_ is None else F.concat(row, F.lit("  "), fixed(sum_, 12, 3), F.lit("  "), fixed(mean, 12, 3))


def scored(line: Column, lineno: Column | None, score: Column | None) -> Column:
    parts = ([] if lineno is None else [F.format_string("%6d", lineno)]) + ([] if score is None else [fixed(score, 7, 2)])
    return F.concat_ws("  ", *parts, line)


def diff(side: Column, text: Column, colour: bool = False) -> Column:
    pick = lambda of: F.element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), side)
    marked = F.concat(pick(SIDES), text)
    return F.concat(pick(SIDE_COLOURS), marked, F.lit("\x1b[0m")) if colour else marked


def annotated(line: Column, lineno: Column | None = None, elapsed_ms: Column | None = None, delta_ms: Column | None = None) -> Column:
    """A line with its number, the milliseconds since the first time and since the one before; a dash where there is none."""
    shown = lambda ms: F.coalesce(fixed(ms, 10, 1), F.lpad(F.lit("-"), 10, " "))
    span = lambda mark, ms: F.concat(F.lit(f"[{mark}"), shown(ms), F.lit("ms]"))
    parts = [] if lineno is None else [F.format_string("[%6d]", lineno)]
    parts += [] if elapsed_ms is None else [span("+", elapsed_ms)]
    parts += [] if delta_ms is None else [span("d", delta_ms)]
    return F.concat_ws(" ", *parts, line)


def context(line: Column, lineno: Column, gap: Column, show_lineno: bool = False, separator: str = "--") -> Column:
    """The lines of text for one row of a context search: a separator ahead of a line after a gap, then the line without white space at its end."""
    bare = rstripped(line)
    text = F.concat(lineno.cast("string"), F.lit(":"), bare) if show_lineno else bare
    return F.when(gap, F.array(F.lit(separator), text)).otherwise(F.array(text))


def stats(total: Column, matched: Column, first: Column, last: Column, levels: Column) -> Column:
    """The summary as lines of text; ``levels`` is a map of counts."""

    def time(t: Column) -> Column:
        return F.regexp_replace(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.000000$", "")

    head = F.array(
        F.concat(F.lit("Total lines   : "), total.cast("string")),
        F.concat(F.lit("Matched lines : "), matched.cast("string")),
        F.concat(F.lit("First ts      : "), time(first)),
        F.concat(F.lit("Last ts       : "), time(last)),
        F.when(F.size(levels) > 0, F.lit("Level counts  :")),
    )
    each = F.transform(F.array_sort(F.map_entries(levels)), lambda e: F.format_string("  %-10s: %d", e["key"], e["value"]))
    return F.concat(F.array_compact(head), F.coalesce(each, F.array().cast("array<string>")))
