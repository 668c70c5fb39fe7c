"""Fields of log lines. Lines are JSON objects or hold key=value pairs; the dialects differ in what a pair is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.once import let

#: name -> pattern of key and value
DIALECTS = {
    "dotted": r'([\w.\-]+)=("[^"]*"|[^\s,]*)',  # field, sort, split, pivot, template
    "plain": r'(\w+)=("[^"]*"|[^\s,]*)',  # normalize
    "greedy": r'(\w+)=("[^"]*"|\S+)',  # column, count: a comma belongs to the value
    "tokens": r"(?:^|(?<=\s))([^=\s]*)=(\S*)(?=\s|$)",  # align, convert, freq, unique
}


def from_json(line: Column) -> Column:
    """Map of a JSON object's fields in order, null if the line is none. Nested values are their JSON text."""
    return F.when(line.rlike(r"(?s)^\s*\{.*\}\s*$"), F.from_json(line, "map<string,string>", {"allowSingleQuotes": "false"}))


def _value(raw: Column, dialect: str) -> Column:
    """A value without the quotes around it; of tokens, without any at its ends."""
    if dialect == "tokens":
        return F.regexp_replace(raw, '^"+|"+$', "")
    return F.when(raw.rlike(r'(?s)^".*"$') & (F.length(raw) > 1), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)


def parsed(line: Column, dialect: str) -> Column:
    """What ``value`` looks fields up in: the JSON fields if the line is an object, else keys and values, last pair first."""
    pattern = F.lit("(?U)" + DIALECTS[dialect])
    found = lambda group: F.reverse(F.regexp_extract_all(line, pattern, F.lit(group)))
    pairs = lambda m: F.struct(m.alias("json"), F.when(m.isNull(), found(1)).alias("keys"), F.when(m.isNull(), found(2)).alias("values"))
    return let(from_json(line), pairs)


def value(found: Column, name: str, dialect: str) -> Column:
    """One field of a ``parsed`` line, null if it has none of that name; of equal keys the last wins."""
    place = F.array_position(found["keys"], F.lit(name))
    pair = let(place, lambda at: F.when(at > 0, _value(F.element_at(found["values"], at.cast("int")), dialect)))
    return F.when(found["json"].isNotNull(), F.try_element_at(found["json"], F.lit(name))).otherwise(pair)


def from_pairs(line: Column, dialect: str) -> Column:
    """Map of key=value pairs, null without any. Of equal keys the last wins, at the place of the first."""
    pattern = F.lit("(?U)" + DIALECTS[dialect])
    found = F.struct(F.regexp_extract_all(line, pattern, F.lit(1)).alias("k"), F.reverse(F.regexp_extract_all(line, pattern, F.lit(2))).alias("v"))

    def to_map(p: Column) -> Column:
        last = lambda k: _value(F.element_at(p["v"], F.array_position(F.reverse(p["k"]), k).cast("int")), dialect)
        return F.when(F.size(p["k"]) > 0, let(F.array_distinct(p["k"]), lambda once: F.map_from_arrays(once, F.transform(once, last))))

    return let(found, to_map)


def fields(line: Column, dialect: str) -> Column:
    """JSON fields if the line is an object, else its pairs."""
    return F.coalesce(from_json(line), from_pairs(line, dialect))


def field(line: Column, name: str, dialect: str = "dotted") -> Column:
    """One field, null if the line has none of that name. A JSON object that lacks it is not searched for pairs."""
    return let(parsed(line, dialect), lambda p: value(p, name, dialect))
