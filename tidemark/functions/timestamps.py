"""Timestamps of log lines, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.once import let

# The forms of time a line may show, in order of precedence, and the keys that may hold one in a JSON line.
PATTERNS = (
    r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)",
    r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})",
    r"(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2})",
    r"(\w{3}\s+\d{1,2} \d{2}:\d{2}:\d{2})",
)
KEYS = ("timestamp", "time", "ts", "@timestamp", "date")


def parse(text: Column) -> Column:
    """A naive timestamp, or null: ISO with T or blank (with T up to six decimals), Apache and syslog forms. A trailing Z is dropped.

    Syslog has no year and gets 1900. Anything else, offsets included, gives null.
    """
    month = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    iso = r"^\d{4}-\d{1,2}-\d{1,2}"
    clock = r"\d{1,2}:\d{1,2}:\d{1,2}"

    def when(value: Column, shape: str, form: str) -> Column:
        return F.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(form)).cast("timestamp_ntz"))

    def forms(s: Column) -> Column:
        squeezed = F.regexp_replace(s, r"\s+", " ")
        return F.coalesce(
            when(s, rf"{iso}T{clock}$", "yyyy-M-d'T'H:m:s"),
            when(s, rf"{iso}T{clock}\.\d{{1,6}}$", "yyyy-M-d'T'H:m:s[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
            when(squeezed, rf"{iso} {clock}$", "yyyy-M-d H:m:s"),
            when(s, rf"^\d{{1,2}}/{month}/\d{{4}}:{clock}$", "d/MMM/yyyy:H:m:s"),
            when(F.concat(F.lit("1900 "), squeezed), rf"^1900 {month} \d{{1,2}} {clock}$", "yyyy MMM d H:m:s"),
        )

    return let(F.regexp_replace(F.trim(text), "Z+$", ""), forms)


def raw(line: Column) -> Column:
    """The text of the first form that the line shows, null if none."""
    found = lambda p: F.nullif(F.regexp_extract(line, "(?U)" + p, 1), F.lit(""))
    return F.coalesce(*map(found, PATTERNS))


def after(line: Column) -> Column:
    """What follows the first form of time in a line, without blanks ahead of it; the line itself if it has no valid time."""
    place = F.instr(line, raw(line)) + F.length(raw(line))
    rest = F.regexp_replace(F.substring(line, place, F.length(line)), r"(?U)^\s+", "")
    return F.when(extract(line).isNotNull() & raw(line).isNotNull(), rest).otherwise(line)


def extract(line: Column) -> Column:
    """The timestamp of a line. In a JSON object the first present key decides, even if its value is no time; else the first
    form found in the text decides, without a second try. Each pattern is looked for once."""

    def named(fields: Column) -> Column:
        first = F.coalesce(*(F.when(F.map_contains_key(fields, F.lit(k)), F.lit(k)) for k in KEYS))
        return F.when(fields.isNotNull(), let(first, lambda k: F.when(k.isNotNull(), F.struct(parse(F.try_element_at(fields, k)).alias("ts")))))

    in_json = let(F.from_json(line, "map<string,string>", {"allowSingleQuotes": "false"}), named)
    plain = parse(raw(line))
    is_json = line.rlike(r"(?s)^\s*\{.*\}\s*$")
    return F.when(is_json, let(in_json, lambda found: F.when(found.isNotNull(), found["ts"]).otherwise(plain))).otherwise(plain)
