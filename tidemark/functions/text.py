"""Changes of single lines, as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fields as fl
from tidemark.functions.once import let
from tidemark.functions.regex import literal, template, to_java

# What redaction knows by name, the forms of time that tell formats apart, and what highlighting looks for.
REDACTIONS = {
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "email": r"\b[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}\b",
    "token": r"\b(?:Bearer\s+)?[A-Za-z0-9_\-]{20,}\b",
    "credit_card": r"\b(?:\d[ -]?){13,16}\b",
    "uuid": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
}
FORMATS = {
    "iso8601": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    "apache": r"\[\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}\]",
    "syslog": r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    "epoch": r"\d{10}(?:\.\d+)?",
    "epoch_ms": r"\d{13}",
}
FORMAT_TEXTS = {
    "iso8601": "ISO 8601 datetime (e.g. 2024-01-15T12:00:00Z)",
    "apache": "Apache/Nginx combined log format",
    "syslog": "Syslog format (e.g. Jan 15 12:00:00)",
    "epoch": "Unix epoch timestamp (seconds)",
    "epoch_ms": "Unix epoch timestamp (milliseconds)",
}
COLOURS = {"CRITICAL|FATAL|ERROR|ERR": "\x1b[31m\x1b[1m", "WARNING|WARN": "\x1b[33m", "INFO": "\x1b[32m", "DEBUG": "\x1b[36m"}
TIME_COLOUR, RESET = "\x1b[36m", "\x1b[0m"
TIMES = (
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    r"\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}",
    r"[A-Za-z]{3} [ \d]\d \d{2}:\d{2}:\d{2}",
)
SIZES = {"b": 1, "k": 1024, "m": 1024**2, "g": 1024**3}


def parse_size(text: str) -> int:
    """Bytes of a size such as ``512``, ``64k`` or ``10m``."""
    text = text.strip().lower()
    if not re.fullmatch(r"[+-]?\d+[bkmg]?", text):
        raise ValueError(f"no size: {text!r}")
    return int(text.rstrip("bkmg")) * SIZES.get(text[-1], 1)


def typed_json(line: Column) -> Column:
    """Map of a JSON object's fields with their types kept, null if the line is none."""
    return F.when(line.rlike(r"(?s)^\s*\{.*\}\s*$"), F.from_json(line, "map<string,variant>", {"allowSingleQuotes": "false"}))


def spaced_json(fields: Column) -> Column:
    """A map as JSON with a blank after each comma and colon. Nested values stay compact."""
    key = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"(?s)^\[|\]$", "")
    pair = lambda e: F.concat(key(e["key"]), F.lit(": "), F.coalesce(F.regexp_replace(F.to_json(F.array(e["value"])), r"(?s)^\[|\]$", ""), F.lit("null")))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(fields), pair), ", "), F.lit("}"))


def strip_ansi(line: Column) -> Column:
    return F.regexp_replace(line, "\x1b\\[[0-9;]*m", "")


def strip_fields(line: Column, names: list[str]) -> Column:
    """Fields go: keys of a JSON object, else key=value words, quoted values included. Lines without either stay."""
    pairs = line
    for n in names:
        pairs = F.trim(F.regexp_replace(pairs, rf'(?U)(?:^|\s)\Q{n}\E=(?:"[^"]*"|\S*)', ""))
    plain = F.when(line.rlike(r"(?U)\w+="), pairs).otherwise(line)
    return let(typed_json(line), lambda m: F.when(m.isNotNull(), spaced_json(F.map_filter(m, lambda k, _: ~k.isin(names)))).otherwise(plain))


def strip_prefix(line: Column, prefix: str) -> Column:
    bare = F.regexp_replace(line, r"(?U)^\s+", "")
    rest = F.regexp_replace(F.substring(bare, len(prefix) + 1, 1 << 30), r"(?U)^\s+", "")
    return F.when(bare.startswith(prefix), rest).otherwise(line)


def strip(line: Column, *, fields: list[str] | None = None, prefix: str | None = None, ansi: bool = False) -> Column:
    """Colours go, then fields, then a prefix, as far as each is asked for."""
    if ansi:
        line = strip_ansi(line)
    if fields:
        line = strip_fields(line, fields)
    return line if prefix is None else strip_prefix(line, prefix)


def mask_positions(line: Column, start: int, end: int, mask: str = "***") -> Column:
    """The characters from start (0-based) to before end; a range that does not lie in the line changes nothing."""
    fits = (F.lit(0 <= start < end)) & (F.length(line) >= end)
    return F.when(fits, F.concat(F.substring(line, 1, start), F.lit(mask), F.substring(line, end + 1, 1 << 30))).otherwise(line)


def mask_pattern(line: Column, pattern: str, mask: str = "***", group: int = 0) -> Column:
    """Every match, or of every match one group; the mask is taken literally. Text that equals the group goes within its match."""
    if not group:
        return F.regexp_replace(line, to_java(pattern), literal(mask))
    p = F.lit(to_java(pattern))
    hits, inner = F.regexp_extract_all(line, p, F.lit(0)), F.regexp_extract_all(line, p, F.lit(group))
    # each match in turn is replaced in what is left of the line; what has been done moves to the front
    step = lambda acc, x: F.struct(
        F.concat(acc["done"], F.substring(acc["rest"], F.lit(1), F.instr(acc["rest"], x["hit"]) - 1), F.replace(x["hit"], x["part"], F.lit(mask))).alias("done"),
        F.substring(acc["rest"], F.instr(acc["rest"], x["hit"]) + F.length(x["hit"]), F.length(acc["rest"])).alias("rest"),
    )
    out = F.aggregate(F.arrays_zip(hits.alias("hit"), inner.alias("part")), F.struct(F.lit("").alias("done"), line.alias("rest")), step)
    return let(out, lambda x: F.concat(x["done"], x["rest"]))


def mask_field(line: Column, name: str, mask: str = "***", sep: str = "=") -> Column:
    return F.regexp_replace(line, rf"(?<=\Q{name}{sep}\E)[^\s,;|]+", literal(mask))


def mask(line: Column, *, pattern: str | None = None, field: str | None = None, mask: str = "***") -> Column:
    """A pattern is masked, then a field, as far as each is asked for."""
    if pattern is not None:
        line = mask_pattern(line, pattern, mask)
    return line if field is None else mask_field(line, field, mask)


def redact(line: Column, builtins: list[str] = (), patterns: list[str] = (), mask: str = "[REDACTED]", ignore_case: bool = False) -> tuple[Column, Column]:
    """The line after all replacements, built-in ones first, and how many there were."""
    unknown = set(builtins) - set(REDACTIONS)
    if unknown:
        raise ValueError(f"unknown redactions: {sorted(unknown)}")
    count = F.lit(0)
    for p in [*(REDACTIONS[b] for b in builtins), *patterns]:
        java = to_java(p, ignore_case)
        count = count + F.regexp_count(line, F.lit(java))
        line = F.regexp_replace(line, java, template(mask))
    return line, count


def truncate(line: Column, width: int = 200, ellipsis: str = "...") -> Column:
    """Lines longer than ``width`` are cut to it, the ellipsis included; an ellipsis that is longer is cut itself."""
    if width <= 0:
        raise ValueError("width must be positive")
    ellipsis = ellipsis[:width]
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - len(ellipsis)), F.lit(ellipsis))).otherwise(line)


def indent(line: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), line)


def outdent(line: Column, prefix: str) -> Column:
    return F.when(line.startswith(prefix), F.substring(line, len(prefix) + 1, 1 << 30)).otherwise(line)


def render(line: Column, lineno: Column, text: str) -> Column:
    """A template: {name} is a field of the line and stays as written if there is none; {_line} and {_lineno} are the line's own.
    Fields are looked up in the pairs or the object, which are found once."""
    parts = re.split(r"\{(\w+)\}", text)

    def filled(found: Column) -> Column:
        out = []
        for i, part in enumerate(parts):
            if i % 2 == 0:
                out.append(F.lit(part))
                continue
            own = {"_line": line, "_lineno": lineno.cast("string")}.get(part, F.lit("{" + part + "}"))
            null = F.when(F.map_contains_key(found["json"], F.lit(part)), F.lit("None"))  # a JSON null
            out.append(F.coalesce(fl.value(found, part, "dotted"), null, own))
        return F.concat(*out)

    return let(fl.parsed(line, "dotted"), filled)


def rename(line: Column, names: dict[str, str]) -> Column:
    """Fields under new names, as JSON or as key=value words; of equal names the later wins. Lines without fields stay."""
    new = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    called = lambda k: F.coalesce(F.try_element_at(new, k), k)

    def turned(m: Column) -> Column:
        # by place: of entries that get one name the last stays, at the place of the first
        keys, values = F.transform(F.map_keys(m), called), F.map_values(m)
        last = lambda k: F.element_at(F.reverse(values), F.array_position(F.reverse(keys), k).cast("int"))
        return let(F.array_distinct(keys), lambda once: F.map_from_arrays(once, F.transform(once, last)))

    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: F.contains(w, F.lit("=")))
    renamed = lambda w: F.concat(called(F.substring_index(w, "=", 1)), F.substring(w, F.instr(w, "="), F.length(w)))
    pairs = let(words, lambda ws: F.when(F.size(ws) > 0, F.array_join(F.transform(ws, renamed), " ")).otherwise(line))
    return let(typed_json(line), lambda m: F.when(m.isNotNull(), F.to_json(turned(m))).otherwise(pairs))


def _quoted(value: Column, when: str) -> Column:
    return F.when(value.rlike(when), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)


def _pairs(m: Column, when: str) -> Column:
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), _quoted(F.coalesce(e["value"], F.lit("None")), when))), " ")


def convert(line: Column, target: str) -> Column:
    """json, kv or plain; a line without fields is the field ``message``."""
    own = F.create_map(F.lit("message"), F.trim(line))
    if target == "json":
        pairs = let(fl.from_pairs(line, "tokens"), lambda m: spaced_json(F.coalesce(m, own)))
        return let(typed_json(line), lambda m: F.when(m.isNotNull(), spaced_json(m)).otherwise(pairs))
    if target == "kv":
        return let(fl.fields(line, "tokens"), lambda m: F.coalesce(_pairs(m, " "), F.concat(F.lit('message="'), F.trim(line), F.lit('"'))))
    if target == "plain":
        return let(fl.fields(line, "tokens"), lambda m: F.coalesce(F.array_join(F.map_values(m), " "), line))
    raise ValueError(f"unknown format: {target}")


def normalize(line: Column, target: str = "json") -> Column:
    """As convert, but compact, lines without fields stay, and values with a blank or = are quoted."""
    if target == "json":
        pairs = let(fl.from_pairs(line, "plain"), lambda m: F.coalesce(F.to_json(m), line))
        return let(typed_json(line), lambda m: F.when(m.isNotNull(), F.to_json(m)).otherwise(pairs))
    if target == "kv":
        return let(fl.fields(line, "plain"), lambda m: F.coalesce(_pairs(m, "[ =]"), line))
    raise ValueError(f"unknown format: {target}")


def cast_field(line: Column, name: str, kind: str) -> Column:
    """One field of a JSON line, not those of that name in its values, as int, float, bool or str; the line is compact then, and stays if the field is absent or does not convert."""
    m = fl.from_json(line)
    v = F.trim(F.try_element_at(m, F.lit(name)))
    value = {
        "int": F.when(v.rlike(r"^[+-]?\d+$"), v.try_cast("long").cast("string")),
        "float": F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v.try_cast("double").cast("string")),
        "bool": F.when(v.isNotNull(), F.when(F.lower(v).isin("true", "1", "yes"), "true").otherwise("false")),
        "str": F.to_json(F.array(v)),
    }[kind]
    if kind == "str":
        value = F.substring(value, F.lit(2), F.length(value) - 2)
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]$", "")

    def put(x: Column) -> Column:
        one = lambda e: F.concat(text(e["key"]), F.lit(":"), F.when(e["key"] == name, x).otherwise(F.coalesce(text(e["value"]), F.lit("null"))))
        return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(typed_json(line)), one), ","), F.lit("}"))

    return F.when(m.isNotNull(), let(value, lambda x: F.when(x.isNotNull(), put(x)).otherwise(line))).otherwise(line)


#: The white space that stripping takes.
BLANKS = r"[\s\x1c-\x1f]+"


def stripped(line: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(line, f"(?U)^{BLANKS}|{BLANKS}$", "")


def rstripped(line: Column) -> Column:
    return F.regexp_replace(line, f"(?U){BLANKS}$", "")


def detect_format(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed(FORMATS.items()):
        out = F.when(line.rlike("(?U)" + p), name).otherwise(out)
    return out


def list_formats() -> list[tuple[str, str]]:
    """The names of the formats that ``detect_format`` knows, in its order, and what they are."""
    return list(FORMAT_TEXTS.items())


def highlight(line: Column, times: bool = True) -> Column:
    """Level names (in upper case, as whole words) in the colour of their level, and times in cyan."""
    for words, colour in COLOURS.items():
        line = F.regexp_replace(line, rf"(?U)\b(?:{words})\b", f"{colour}$0{RESET}")
    return F.regexp_replace(line, "(?U)(?:" + "|".join(TIMES) + ")", f"{TIME_COLOUR}$0{RESET}") if times else line
