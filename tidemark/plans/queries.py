"""The library's queries over log renderings of the test tables, with DuckDB SQL of the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import fields, levels, report, text, timestamps
from tidemark.functions.order import keyed
from tidemark.operators import ordered, rows, tables
from tidemark.sources import logs
from tidemark.streaming import merging, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END"
KV_SQL = f"""SELECT event_id + 1 AS lineno, ts, event_type, user_id, {_LEVEL} AS level, CAST(round(value * 100) AS BIGINT) AS v,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || {_LEVEL} || ' user=' || user_id || ' type=' || event_type || ' value=' || CAST(round(value * 100) AS BIGINT) AS line FROM events"""
#: Lines in the forms of many programs, by event_id modulo 10: with times of all kinds, with none, with personal data.
_MIXED_LEVEL = "CASE event_type WHEN 'error' THEN ['ERROR', 'ERR', 'CRITICAL', 'FATAL'][1 + user_id % 4] WHEN 'signup' THEN ['WARN', 'WARNING'][1 + user_id % 2] WHEN 'click' THEN 'INFO' ELSE 'DEBUG' END"
MIXED_SQL = f"""SELECT event_id + 1 AS lineno, event_id % 10 AS form, ts, user_id, {_MIXED_LEVEL} AS level,
  CASE event_id % 10
    WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' || {_MIXED_LEVEL} || ' user=' || user_id
    WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || ' ' || {_MIXED_LEVEL} || ' mail=user' || user_id || '@example.org done'
    WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ',250 ' || {_MIXED_LEVEL} || ' from 10.0.' || user_id % 256 || '.7 done'
    WHEN 3 THEN '10.1.2.3 - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] GET /' || user_id || ' ' || {_MIXED_LEVEL}
    WHEN 4 THEN strftime(ts, '%b %d %H:%M:%S') || ' host app: ' || {_MIXED_LEVEL} || ' key Bearer ' || md5('k' || user_id) || ' used'
    WHEN 5 THEN 'user=' || user_id || ' ' || {_MIXED_LEVEL} || ' card 4111 1111 1111 1111 kept'
    WHEN 6 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00 ' || {_MIXED_LEVEL} || ' id 123e4567-e89b-12d3-a456-426614174000 seen'
    WHEN 7 THEN '{{"time":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","level":"' || {_MIXED_LEVEL} || '","user":{{"id":' || user_id || ',"tags":["a",{{"b":true}}]}}}}'
    WHEN 8 THEN '1704276000.5 ' || {_MIXED_LEVEL} || ' user=' || user_id
    ELSE '' END AS line FROM events"""
#: The time that a mixed line shows.
_MIXED_TS = "CASE WHEN form IN (0, 2, 3, 7) THEN date_trunc('second', ts) WHEN form = 1 THEN ts WHEN form = 4 THEN date_trunc('second', ts) - to_years(CAST(year(ts) - 1900 AS INTEGER)) END"
WORDS_SQL = """SELECT doc_id AS file_id, CAST(i AS BIGINT) AS lineno, parts[i] AS line
  FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))"""


def log_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as key=value lines of one file."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    line = F.concat_ws(
        " ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), level, F.concat(F.lit("user="), "user_id"), F.concat(F.lit("type="), "event_type"), F.concat(F.lit("value="), F.round(F.col("value") * 100).cast("long"))
    )
    return e.select(F.lit("events.log").alias("file"), (F.col("event_id") + 1).alias("lineno"), line.alias("line"))


def log_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines of one file."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    body = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("type"), F.col("user_id").alias("user"), F.round(F.col("value") * 100).cast("long").alias("value")))
    return e.select(F.lit("events.json").alias("file"), (F.col("event_id") + 1).alias("lineno"), body.alias("line"))


def log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents; each document is a file."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    lines = d.select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("file", (F.col("i") + 1).cast("long").alias("lineno"), "line")


def log_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one file of lines in ten forms."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    pick = lambda of: F.element_at(F.array(*map(F.lit, of)), (F.col("user_id") % len(of) + 1).cast("int"))
    level = F.when(F.col("event_type") == "error", pick(["ERROR", "ERR", "CRITICAL", "FATAL"])).when(F.col("event_type") == "signup", pick(["WARN", "WARNING"])).when(F.col("event_type") == "click", "INFO").otherwise("DEBUG")
    time, user = lambda form: F.date_format("ts", form), F.col("user_id").cast("string")
    forms = [
        (time("yyyy-MM-dd'T'HH:mm:ss'Z'"), " ", level, " user=", user),
        (time("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), " ", level, " mail=user", user, "@example.org done"),
        (time("yyyy-MM-dd HH:mm:ss"), ",250 ", level, " from 10.0.", (F.col("user_id") % 256).cast("string"), ".7 done"),
        ("10.1.2.3 - - [", time("dd/MMM/yyyy:HH:mm:ss"), " +0000] GET /", user, " ", level),
        (time("MMM dd HH:mm:ss"), " host app: ", level, " key Bearer ", F.md5(F.concat(F.lit("k"), user)), " used"),
        ("user=", user, " ", level, " card 4111 1111 1111 1111 kept"),
        (time("yyyy-MM-dd'T'HH:mm:ss"), "+02:00 ", level, " id 123e4567-e89b-12d3-a456-426614174000 seen"),
        ('{"time":"', time("yyyy-MM-dd HH:mm:ss"), '","level":"', level, '","user":{"id":', user, ',"tags":["a",{"b":true}]}}'),
        ("1704276000.5 ", level, " user=", user),
        ("",),
    ]
    line = F.lit("")
    for i, parts in enumerate(forms):
        line = F.when(F.col("event_id") % 10 == i, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))).otherwise(line)
    return e.select(F.lit("mixed.log").alias("file"), (F.col("event_id") + 1).alias("lineno"), line.alias("line"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{kv}", KV_SQL).replace("{text}", WORDS_SQL).replace("{mixed}", MIXED_SQL).replace("{mixed_ts}", _MIXED_TS)
        return f

    return add


@query("WITH l AS ({kv}) SELECT date_trunc('hour', ts) AS bucket, count(*) AS count, count(*) / 3600.0 AS per_second FROM l GROUP BY 1")
def rate_hour(spark, sf):
    return rows.rate(log_kv(spark, sf), 3600)


@query("WITH l AS ({kv}) SELECT lineno, line FROM l WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-10 12:00:00'")
def time_range(spark, sf):
    return rows.time_range(log_kv(spark, sf), datetime(2024, 1, 3), datetime(2024, 1, 10, 12)).select("lineno", "line")


@query("WITH l AS ({kv}) SELECT lineno, line FROM l WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-14 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'")
def last_window(spark, sf):
    return rows.last_window(log_kv(spark, sf), 86_400, datetime(2024, 1, 15)).select("lineno", "line")


@query("WITH l AS ({kv}) SELECT lineno, line FROM l WHERE regexp_matches(line, 'type=(error|signup) value=1')")
def grep(spark, sf):
    return rows.grep(log_kv(spark, sf), r"type=(error|signup) value=1").select("lineno", "line")


@query("WITH l AS ({kv}) SELECT count(*) AS n FROM l WHERE NOT contains(line, 'ERROR')")
def grep_count_inverted(spark, sf):
    return rows.grep(log_kv(spark, sf), "ERROR", invert=True, fixed=True).agg(F.count("*").alias("n"))


@query(
    """WITH l AS ({kv}), m AS (SELECT lineno, line, event_type = 'error' AS is_match, bool_or(event_type = 'error') OVER (ORDER BY lineno ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM l)
SELECT lineno, line, is_match, lineno - coalesce(lag(lineno) OVER (ORDER BY lineno), 0) > 1 AS gap FROM m WHERE near"""
)
def grep_context(spark, sf):
    return ordered.context(log_kv(spark, sf), "ERROR", before=2, after=1, block=1000).select("lineno", "line", "is_match", "gap")


@query("WITH l AS ({kv}) SELECT lineno, line FROM l WHERE event_type = 'purchase'")
def field_equals(spark, sf):
    return rows.field_equals(log_kv(spark, sf), "type", "purchase").select("lineno", "line")


@query("WITH l AS ({kv}) SELECT lineno, line FROM l WHERE level IN ('WARN', 'ERROR')")
def level_range(spark, sf):
    return rows.level_range(log_kv(spark, sf), "warn", "error").select("lineno", "line")


@query("WITH l AS ({kv}) SELECT lineno, line FROM l WHERE lineno % 7 = 0")
def every_nth(spark, sf):
    return rows.every(log_kv(spark, sf), 7).select("lineno", "line")


@query("WITH l AS ({kv}) SELECT lineno, line FROM l WHERE lineno BETWEEN 101 AND 450")
def clip(spark, sf):
    return rows.clip(log_kv(spark, sf), 101, 450).select("lineno", "line")


@query("WITH l AS ({kv}) SELECT lineno, line FROM l WHERE lineno <= 25")
def head(spark, sf):
    return rows.head(log_kv(spark, sf), 25).select("lineno", "line")


@query("WITH l AS ({kv}) SELECT lineno, line FROM l ORDER BY lineno DESC LIMIT 25")
def tail(spark, sf):
    return rows.tail(log_kv(spark, sf), 25).select("lineno", "line")


@query("WITH l AS ({kv}) SELECT lineno, line FROM (SELECT lineno, line, sum(strlen(line) + 1) OVER (ORDER BY lineno) AS e FROM l) WHERE e <= 100000")
def byte_limit(spark, sf):
    return ordered.byte_limit(log_kv(spark, sf), 100_000, block=500).select("lineno", "line")


@query("WITH l AS ({kv}), c AS (SELECT user_id::VARCHAR AS value, count(*) AS count, min(lineno) AS first FROM l GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 10) SELECT value, count, first, count * 100.0 / sum(count) OVER () AS pct FROM c")
def freq_top(spark, sf):
    return rows.frequency(log_kv(spark, sf), "user", 10)


@query("WITH l AS ({kv}) SELECT event_type AS value, count(*) AS count FROM l GROUP BY 1")
def count_field(spark, sf):
    return rows.count_field(log_kv(spark, sf), "type")


@query("WITH l AS ({kv}) SELECT value, count(*) AS count FROM (SELECT unnest(regexp_extract_all(line, 'user=(\\d+)', 1)) AS value FROM l) GROUP BY 1")
def count_pattern(spark, sf):
    return rows.count_pattern(log_kv(spark, sf), r"user=(\d+)")


@query("WITH t AS ({text}), s AS (SELECT trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ') AS value FROM t) SELECT value, count(*) AS count FROM s WHERE value <> '' GROUP BY 1")
def count_lines(spark, sf):
    return rows.count_lines(log_text(spark, sf))


@query("WITH l AS ({kv}) SELECT event_type AS key, count(*) AS count, CAST(sum(v) AS DOUBLE) AS sum, sum(v) / count(*) AS mean FROM l GROUP BY 1")
def pivot_sum_mean(spark, sf):
    return rows.pivot(log_json(spark, sf), "type", "value")


@query(
    """WITH l AS ({kv}), m AS (SELECT * FROM l WHERE level <> 'INFO')
SELECT (SELECT count(*) FROM l) AS total_lines, count(*) AS matched_lines, date_trunc('second', arg_min(ts, lineno)) AS first_timestamp, date_trunc('second', arg_max(ts, lineno)) AS last_timestamp,
  count(*) FILTER (WHERE level = 'ERROR') AS errors, count(*) FILTER (WHERE level = 'WARN') AS warnings FROM m"""
)
def stats(spark, sf):
    log = log_kv(spark, sf)
    s = rows.stats(log, rows.level_range(log, "warn"))
    return s.select("total_lines", "matched_lines", "first_timestamp", "last_timestamp", F.col("level_counts")["ERROR"].alias("errors"), F.col("level_counts")["WARN"].alias("warnings"))


@query(
    """WITH l AS ({kv}), s AS (SELECT lineno, date_trunc('second', ts) AS t FROM l)
SELECT lineno, CAST(epoch_ms(t) - epoch_ms(min(t) OVER ()) AS DOUBLE) AS elapsed_ms, CAST(epoch_ms(t) - epoch_ms(lag(t) OVER (ORDER BY lineno)) AS DOUBLE) AS delta_ms FROM s"""
)
def annotate(spark, sf):
    return ordered.annotate(log_kv(spark, sf), block=777).select("lineno", "elapsed_ms", "delta_ms")


@query("WITH t AS ({text}) SELECT file_id::VARCHAR AS file, lineno, line FROM (SELECT *, lag(line) OVER (PARTITION BY file_id ORDER BY lineno) AS p FROM t) WHERE p IS NULL OR p <> line")
def dedupe_adjacent(spark, sf):
    return ordered.dedupe_adjacent(log_text(spark, sf), block=16)


@query("WITH l AS ({kv}) SELECT min(lineno) AS lineno, arg_min(line, lineno) AS line FROM l GROUP BY user_id")
def unique_field(spark, sf):
    return ordered.unique(log_kv(spark, sf), fields.field(F.col("line"), "user", "tokens")).select("lineno", "line")


@query("WITH l AS ({kv}) SELECT event_type AS value, min(lineno) AS first FROM l GROUP BY 1")
def unique_values(spark, sf):
    return ordered.unique_values(log_kv(spark, sf), fields.field(F.col("line"), "type", "tokens"))


@query(
    """WITH t AS (SELECT lineno, level || ' ' || event_type || ' ' || user_id % 3 AS line FROM ({kv})),
s AS (SELECT *, regexp_replace(line, '\\b\\d+\\b', '#', 'g') AS sig FROM t), n AS (SELECT *, CASE WHEN sig = lag(sig) OVER (ORDER BY lineno) THEN 0 ELSE 1 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (ORDER BY lineno) AS island FROM n), r AS (SELECT island, min(lineno) AS lineno, arg_min(line, lineno) AS line, count(*) AS n FROM i GROUP BY 1)
SELECT lineno, CASE WHEN n > 1 THEN line || '  [repeated ' || n || 'x]' ELSE line END AS line, n AS repeated FROM r"""
)
def squash(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    log = e.select(F.lit("e").alias("file"), (F.col("event_id") + 1).alias("lineno"), F.concat_ws(" ", level, "event_type", F.col("user_id") % 3).alias("line"))
    return ordered.squash(log, block=321).select("lineno", "line", "repeated")


@query("WITH l AS ({kv}) SELECT lineno, (lineno - 1) // 250 AS chunk FROM l")
def chunk_count(spark, sf):
    return ordered.chunk_count(log_kv(spark, sf), 250).select("lineno", "chunk")


@query(
    """WITH RECURSIVE l AS (SELECT lineno, date_trunc('second', ts) AS t FROM ({kv})),
c(lineno, t, s, chunk) AS (SELECT lineno, t, t, 0 FROM l WHERE lineno = 1 UNION ALL
  SELECT l.lineno, l.t, CASE WHEN l.t - c.s >= INTERVAL 1 HOUR THEN l.t ELSE c.s END, CASE WHEN l.t - c.s >= INTERVAL 1 HOUR THEN c.chunk + 1 ELSE c.chunk END FROM c JOIN l ON l.lineno = c.lineno + 1)
SELECT lineno, CAST(chunk AS BIGINT) AS chunk FROM c"""
)
def chunk_seconds(spark, sf):
    return ordered.chunk_seconds(log_kv(spark, sf), 3600).select("lineno", "chunk")


@query(
    """WITH RECURSIVE t AS (SELECT file_id, lineno, line FROM ({text})),
c(file_id, lineno, line, seen, kept) AS (SELECT file_id, lineno, line, [line], true FROM t WHERE lineno = 1 UNION ALL
  SELECT t.file_id, t.lineno, t.line, CASE WHEN list_contains(c.seen, t.line) THEN c.seen ELSE list_append(c.seen, t.line)[-8:] END, NOT list_contains(c.seen, t.line)
  FROM c JOIN t ON t.file_id = c.file_id AND t.lineno = c.lineno + 1)
SELECT file_id::VARCHAR AS file, lineno, line FROM c WHERE kept"""
)
def dedupe_cached(spark, sf):
    return ordered.dedupe_cached(log_text(spark, sf), 8)


@query("WITH l AS ({kv}) SELECT 'events.json' AS file, lineno * 10 AS lineno, '{\"ts\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '\",\"type\":\"' || event_type || '\",\"user\":' || user_id || ',\"value\":' || v || '}' AS line FROM l")
def compact_json(spark, sf):
    broken = log_json(spark, sf).select("file", F.col("lineno"), F.posexplode(F.split("line", "(?<=,)")).alias("i", "line"))
    return ordered.compact_json(broken.select("file", (F.col("lineno") * 10 + F.col("i")).alias("lineno"), "line"), block=100_003)


@query(
    """WITH t AS ({text}), s AS (SELECT file_id, lineno, (CASE WHEN regexp_matches(line, '(?i)the') THEN 2.0 ELSE 0 END) + (CASE WHEN regexp_matches(line, '(?i)license') THEN 5.0 ELSE 0 END) AS score FROM t)
SELECT file_id::VARCHAR AS file, lineno, score FROM s WHERE score >= 3"""
)
def score(spark, sf):
    return rows.score(log_text(spark, sf), {"the": 2.0, "license": 5.0}, 3.0).select("file", "lineno", "score")


def _places(lines: DataFrame, order: list) -> DataFrame:
    """Each line's number and its place in an order; the lines themselves are not sorted with their keys."""
    keys, by = keyed(lines, order)
    return ordered.numbered(keys.drop("file", "line"), *by, name="place").select("lineno", "place")


@query("WITH l AS ({kv}) SELECT lineno, row_number() OVER (ORDER BY v DESC, lineno) AS place FROM l")
def sort_field(spark, sf):
    return _places(log_kv(spark, sf), rows.field_order("value", reverse=True, numeric=True))


@query("WITH l AS (SELECT lineno, line, {mixed_ts} AS t FROM ({mixed})) SELECT lineno, row_number() OVER (ORDER BY t IS NULL DESC, t DESC, CASE WHEN t IS NULL THEN line END DESC, lineno) AS place FROM l")
def sort_time_reversed(spark, sf):
    return _places(log_mixed(spark, sf), rows.time_order(reverse=True))


@query("WITH l AS ({kv}) SELECT lineno, row_number() OVER (ORDER BY user_id::VARCHAR, lineno) AS place FROM l")
def sort_field_whole(spark, sf):
    return _places(log_kv(spark, sf), rows.field_order("user"))


@query("WITH l AS ({kv}) SELECT lineno, row_number() OVER (ORDER BY date_trunc('second', ts) DESC, lineno) AS place FROM l")
def sort_time_reversed_whole(spark, sf):
    return _places(log_kv(spark, sf), rows.time_order(reverse=True))


@query("WITH l AS ({kv}), n AS (SELECT 'f' || user_id % 3 AS file, row_number() OVER (PARTITION BY user_id % 3 ORDER BY lineno) AS lineno, date_trunc('second', ts) AS ets FROM l) SELECT file, lineno, ets, row_number() OVER (ORDER BY ets, lineno, file) AS rank FROM n")
def merge_sources(spark, sf):
    e = log_kv(spark, sf).withColumn("file", F.concat(F.lit("f"), F.regexp_extract("line", r"user=(\d+)", 1).cast("long") % 3))
    placed = ordered.numbered(e, "file", "lineno", name="place")
    first = placed.groupBy("file").agg(F.min("place").alias("first"))
    log = placed.join(F.broadcast(first), "file").select("file", (F.col("place") - F.col("first") + 1).alias("lineno"), "line")
    return ordered.merge(log, block=30_000).select("file", "lineno", "ets", "rank")


_TWO = """WITH t AS ({text}), a AS (SELECT row_number() OVER (ORDER BY file_id, lineno) AS lineno, line FROM t),
u AS (SELECT conv_id, turn, CAST(i AS BIGINT) AS i, parts[i] AS line FROM (SELECT conv_id, turn, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM conversations WHERE text IS NOT NULL))),
b AS (SELECT row_number() OVER (ORDER BY conv_id, turn, i, line) AS lineno, line FROM u)"""


@query(
    _TWO
    + """, k AS (SELECT line, max(lineno) AS r FROM b GROUP BY line)
SELECT CASE WHEN k.r IS NULL THEN 'left' ELSE 'both' END AS side, a.lineno AS lineno_left, k.r AS lineno_right, a.line AS text FROM a LEFT JOIN k ON a.line = k.line
UNION ALL SELECT 'right', NULL, b.lineno, b.line FROM b WHERE b.lineno NOT IN (SELECT r FROM k WHERE line IN (SELECT line FROM a))"""
)
def diff_sources(spark, sf):
    """All lines of all documents against all lines of all conversations."""
    t = log_text(spark, sf).withColumn("n", F.col("file").cast("long"))
    left = ordered.numbered(t.select("n", "lineno", "line"), "n", "lineno", name="place").select(F.lit("x").alias("file"), F.col("place").alias("lineno"), "line")
    c = spark.read.parquet(f"{sf}/conversations.parquet").filter("text is not null").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    right = ordered.numbered(c, "conv_id", "turn", "i", "line", name="place").select(F.lit("y").alias("file"), F.col("place").alias("lineno"), "line")
    return ordered.diff(left, right, F.col("line"))


_WHOLE = "WITH t AS ({text}), a AS (SELECT row_number() OVER (ORDER BY file_id, lineno) AS lineno, line FROM t), b AS (SELECT lineno, regexp_replace(line, '\\d+', '#', 'g') AS line FROM a)"


@query(
    _WHOLE
    + """, k AS (SELECT line, max(lineno) AS r FROM b GROUP BY line)
SELECT CASE WHEN k.r IS NULL THEN 'left' ELSE 'both' END AS side, a.lineno AS lineno_left, k.r AS lineno_right, a.line AS text FROM a LEFT JOIN k ON a.line = k.line
UNION ALL SELECT 'right', NULL, b.lineno, b.line FROM b WHERE b.lineno NOT IN (SELECT r FROM k WHERE line IN (SELECT line FROM a))"""
)
def diff_sources_whole(spark, sf):
    """All lines of all documents against the same lines with their numbers masked."""
    t = log_text(spark, sf).withColumn("n", F.col("file").cast("long"))
    left = ordered.numbered(t.select("n", "lineno", "line"), "n", "lineno", name="place").select(F.lit("x").alias("file"), F.col("place").alias("lineno"), "line")
    right = left.withColumn("line", F.regexp_replace("line", r"\d+", "#"))
    return ordered.diff(left, right, F.col("line"))


def _lines(name: str, column, sql: str, log=log_kv):
    def run(spark, sf):
        return log(spark, sf).select("lineno", column(F.col("line"), F.col("lineno")).alias("out"))

    run.__name__ = name
    query("WITH l AS ({kv}) SELECT lineno, " + sql + " AS out FROM l")(run)


_JSON = """'{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","type":"' || event_type || '","user":' || user_id || ',"value":' || v || '}'"""
_lines("extract_time", lambda c, n: timestamps.extract(c), "date_trunc('second', ts)")
_lines("extract_level", lambda c, n: levels.extract(c), "CASE level WHEN 'WARN' THEN 'warning' ELSE lower(level) END")
_lines("detect_format", lambda c, n: text.detect_format(c), "'iso8601'")
_lines("redact", lambda c, n: text.redact(c, ["ipv4"], [r"user=\d+"], "#")[0], "regexp_replace(line, 'user=\\d+', '#', 'g')")
_lines("mask_field", lambda c, n: text.mask_field(c, "user"), "regexp_replace(line, '(user=)[^\\s,;|]+', '\\1***', 'g')")
_lines("mask_pattern", lambda c, n: text.mask_pattern(c, r"\d+", "$"), "regexp_replace(line, '\\d+', '$', 'g')")
_lines("mask_group", lambda c, n: text.mask_pattern(c, r"user=(\d+)", "***", 1), "regexp_replace(line, 'user=\\d+', 'user=***', 'g')")
_lines("mask_positions", lambda c, n: text.mask_positions(c, 4, 10, "_"), "line[1:4] || '_' || line[11:]")
_lines("truncate", lambda c, n: text.truncate(c, 30), "CASE WHEN length(line) > 30 THEN line[1:27] || '...' ELSE line END")
_lines("template", lambda c, n: text.render(c, n, "[{type}] {_lineno} {user} {missing}"), "'[' || event_type || '] ' || lineno || ' ' || user_id || ' {missing}'")
_lines("rename", lambda c, n: text.rename(c, {"user": "uid", "value": "amount"}), "'uid=' || user_id || ' type=' || event_type || ' amount=' || v")
_lines("strip_fields", lambda c, n: text.strip_fields(c, ["user", "value"]), "strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || level || ' type=' || event_type")
_lines("convert_kv", lambda c, n: text.convert(c, "kv"), "'ts=' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' type=' || event_type || ' user=' || user_id || ' value=' || v", log_json)
_lines("convert_json", lambda c, n: text.convert(c, "json"), """'{"user": "' || user_id || '", "type": "' || event_type || '", "value": "' || v || '"}'""")
_lines("convert_plain", lambda c, n: text.convert(c, "plain"), "user_id || ' ' || event_type || ' ' || v")
_lines("normalize_json", lambda c, n: text.normalize(c, "json"), """'{"user":"' || user_id || '","type":"' || event_type || '","value":"' || v || '"}'""")
_lines("cast_field", lambda c, n: text.cast_field(c, "user", "float"), _JSON.replace("user_id ||", "user_id || '.0' ||"), log_json)
_lines("columns", lambda c, n: F.concat_ws("|", *(F.coalesce(F.try_element_at(fields.from_pairs(c, "greedy"), F.lit(k)), F.lit("-")) for k in ("user", "nope", "type"))), "user_id || '|-|' || event_type")
_lines("indent", lambda c, n: text.indent(c, "> "), "'> ' || line")
_lines("outdent", lambda c, n: text.outdent(c, "2024"), "CASE WHEN starts_with(line, '2024') THEN line[5:] ELSE line END")

_ESC = "chr(27) || '["
_HIGH = f"""CASE form
  WHEN 0 THEN {_ESC}36m' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || {_ESC}0m' || ' ' || shown || ' user=' || user_id
  WHEN 1 THEN {_ESC}36m' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || {_ESC}0m' || ' ' || shown || ' mail=user' || user_id || '@example.org done'
  WHEN 2 THEN {_ESC}36m' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ',250' || {_ESC}0m' || ' ' || shown || ' from 10.0.' || user_id % 256 || '.7 done'
  WHEN 3 THEN '10.1.2.3 - - [' || {_ESC}36m' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000' || {_ESC}0m' || '] GET /' || user_id || ' ' || shown
  WHEN 4 THEN {_ESC}36m' || strftime(ts, '%b %d %H:%M:%S') || {_ESC}0m' || ' host app: ' || shown || ' key Bearer ' || md5('k' || user_id) || ' used'
  WHEN 5 THEN 'user=' || user_id || ' ' || shown || ' card 4111 1111 1111 1111 kept'
  WHEN 6 THEN {_ESC}36m' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' || {_ESC}0m' || ' ' || shown || ' id 123e4567-e89b-12d3-a456-426614174000 seen'
  WHEN 7 THEN '{{"time":"' || {_ESC}36m' || strftime(ts, '%Y-%m-%d %H:%M:%S') || {_ESC}0m' || '","level":"' || shown || '","user":{{"id":' || user_id || ',"tags":["a",{{"b":true}}]}}}}'
  WHEN 8 THEN '1704276000.5 ' || shown || ' user=' || user_id ELSE '' END"""
_SHOWN = f"CASE level WHEN 'INFO' THEN {_ESC}32m' WHEN 'DEBUG' THEN {_ESC}36m' WHEN 'WARN' THEN {_ESC}33m' WHEN 'WARNING' THEN {_ESC}33m' ELSE {_ESC}31m' || {_ESC}1m' END || level || {_ESC}0m'"


def _mixed(name: str, column, sql: str, extra: str = ""):
    def run(spark, sf):
        return log_mixed(spark, sf).select("lineno", column(F.col("line"), F.col("lineno")).alias("out"))

    run.__name__ = name
    query(f"WITH l AS (SELECT *{extra} FROM ({{mixed}})) SELECT lineno, {sql} AS out FROM l")(run)


_mixed("highlight", lambda c, n: text.highlight(c), _HIGH, f", {_SHOWN} AS shown")
_mixed("detect_format_mixed", lambda c, n: text.detect_format(c), "CASE WHEN form IN (0, 1, 2, 6, 7) THEN 'iso8601' WHEN form = 3 THEN 'apache' WHEN form = 4 THEN 'syslog' WHEN form = 8 THEN 'epoch' END")
_mixed("extract_time_mixed", lambda c, n: timestamps.extract(c), "{mixed_ts}")
_REDACTED = "CASE form WHEN 1 THEN regexp_replace(line, 'user[0-9]+@example.org', '#') WHEN 2 THEN regexp_replace(line, '10[.]0[.][0-9]+[.]7', '#') WHEN 3 THEN regexp_replace(line, '^10.1.2.3', '#') WHEN 4 THEN regexp_replace(line, 'Bearer [0-9a-f]{32}', '#') WHEN 5 THEN regexp_replace(line, '4111 1111 1111 1111 ?', '#') WHEN 6 THEN regexp_replace(line, '123e4567-e89b-12d3-a456-426614174000', '#') ELSE line END"
_mixed("redact_mixed", lambda c, n: text.redact(c, ["email", "ipv4", "uuid", "credit_card", "token"], mask="#")[0], _REDACTED)
_mixed("flatten", lambda c, n: tables.flatten(c), """CASE form WHEN 7 THEN '{"time": "' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '", "level": "' || level || '", "user.id": ' || user_id || ', "user.tags.0": "a", "user.tags.1.b": true}' ELSE line END""")
_mixed("numbered", lambda c, n: report.numbered(c, n), "printf('%6d: %s', lineno, line)")
_lines("strip_prefix", lambda c, n: text.strip_prefix(c, "2024-01-"), "CASE WHEN starts_with(line, '2024-01-') THEN line[9:] ELSE line END")
_lines("strip_ansi", lambda c, n: text.strip_ansi(F.concat(F.lit("\x1b[31m"), c, F.lit("\x1b[0m"))), "line")
_lines("strip_pipeline", lambda c, n: text.strip(F.concat(F.lit("\x1b[1;31m"), c), fields=["user"], prefix="2024-", ansi=True), "CASE WHEN starts_with(line, '2024-') THEN regexp_replace(line, ' user=[0-9]+', '')[6:] ELSE regexp_replace(line, ' user=[0-9]+', '') END")
_lines("mask_pipeline", lambda c, n: text.mask(c, pattern=r"\d{4}-\d{2}", field="user"), "regexp_replace(regexp_replace(line, '[0-9]{4}-[0-9]{2}', '***', 'g'), 'user=[0-9]+', 'user=***')")


@query("WITH l AS (SELECT lineno, line, {mixed_ts} AS t FROM ({mixed})) SELECT lineno, line FROM l WHERE trim(line) <> '' AND t BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-10 12:00:00'")
def time_range_mixed(spark, sf):
    return rows.time_range(log_mixed(spark, sf), datetime(2024, 1, 3), datetime(2024, 1, 10, 12)).select("lineno", "line")


@query("WITH l AS (SELECT lineno, line, {mixed_ts} AS t FROM ({mixed})) SELECT lineno, line FROM l WHERE t IS NULL OR t BETWEEN TIMESTAMP '2024-01-14 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'")
def last_window_mixed(spark, sf):
    return rows.last_window(log_mixed(spark, sf), 86_400, datetime(2024, 1, 15)).select("lineno", "line")


@query(
    """WITH l AS (SELECT lineno, CASE WHEN event_type = 'purchase' THEN 'no fields' ELSE 'user=' || user_id || ' type=' || event_type END AS line, user_id::VARCHAR AS u, event_type AS t FROM ({kv})),
w AS (SELECT greatest(4, max(length(u))) AS a, greatest(4, max(length(t))) AS b FROM l WHERE line <> 'no fields')
SELECT lineno, CASE WHEN line = 'no fields' THEN line ELSE rpad(u, CAST(a AS INTEGER), ' ') || '  ' || rpad('-', 4, ' ') || '  ' || rpad(t, CAST(b AS INTEGER), ' ') END AS line FROM l, w"""
)
def align(spark, sf):
    kv, c = log_kv(spark, sf), F.col("line")
    short = F.when(c.contains("type=purchase"), F.lit("no fields")).otherwise(F.regexp_extract(c, r"user=\d+ type=\w+", 0))
    return tables.align(kv.withColumn("line", short), ["user", "nope", "type"]).select("lineno", "line")


@query(
    """WITH l AS ({kv}), r AS (SELECT 0 AS lineno, 'USER' AS u, 'TYPE' AS t UNION ALL SELECT lineno, user_id::VARCHAR, event_type FROM l), w AS (SELECT max(length(u)) AS a, max(length(t)) AS b FROM r)
SELECT lineno, rtrim(rpad(u, CAST(a AS INTEGER), ' ') || '  ' || rpad(t, CAST(b AS INTEGER), ' ')) AS line FROM r, w"""
)
def column_table(spark, sf):
    return tables.columns(log_kv(spark, sf), ["user", "type"]).select("lineno", "line")


@query("WITH l AS ({kv}) SELECT (lineno - 1) // 250 + 1 AS chunk, lineno, line FROM l UNION ALL SELECT DISTINCT (lineno - 1) // 250 + 1, 0, '--- part ' || CAST((lineno - 1) // 250 + 1 AS VARCHAR) || ' ---' FROM l")
def chunk_lines(spark, sf):
    return tables.chunk_lines(ordered.chunk_count(log_kv(spark, sf), 250), "part").select("chunk", "lineno", "line")


@query(
    """WITH l AS ({kv}), c AS (SELECT user_id::VARCHAR AS value, count(*) AS n, min(lineno) AS first FROM l GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 10)
SELECT row_number() OVER (ORDER BY n DESC, first) AS place, lpad(n::VARCHAR, CAST(length(max(n) OVER ()::VARCHAR) AS INTEGER), ' ') || '  ' || printf('%5.1f', n / sum(n) OVER () * 100) || '%  ' || value AS line FROM c"""
)
def freq_lines(spark, sf):
    return tables.frequency_lines(rows.frequency(log_kv(spark, sf), "user", 10))


@query("WITH l AS ({kv}) SELECT event_type AS value, count(*)::VARCHAR || chr(9) || event_type AS line FROM l GROUP BY 1")
def count_lines_text(spark, sf):
    return rows.count_field(log_kv(spark, sf), "type").select("value", report.count(F.col("value"), F.col("count")).alias("line"))


@query("WITH l AS ({kv}) SELECT date_trunc('hour', ts) AS bucket, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') || printf('  %6d events  (%.2f/s)', count(*), count(*) / 3600.0) AS line FROM l GROUP BY 1")
def rate_lines(spark, sf):
    return rows.rate(log_kv(spark, sf), 3600).select("bucket", report.rate(F.col("bucket"), F.col("count"), 3600).alias("line"))


@query("WITH l AS ({kv}) SELECT event_type AS key, printf('%-30s  %8d  %12.3f  %12.3f', event_type, count(*), CAST(sum(v) AS DOUBLE), sum(v) / count(*)) AS line FROM l GROUP BY 1 UNION ALL SELECT NULL, 'KEY                                COUNT           SUM          MEAN' UNION ALL SELECT NULL, repeat('-', 68)")
def pivot_lines(spark, sf):
    return tables.pivot_lines(rows.pivot(log_json(spark, sf), "type", "value")).select("key", "line")


@query(
    """WITH l AS ({kv}), m AS (SELECT * FROM l WHERE level <> 'INFO'), r AS (
SELECT ['Total lines   : ' || (SELECT count(*) FROM l), 'Matched lines : ' || count(*), 'First ts      : ' || strftime(arg_min(ts, lineno), '%Y-%m-%d %H:%M:%S'), 'Last ts       : ' || strftime(arg_max(ts, lineno), '%Y-%m-%d %H:%M:%S'),
  'Level counts  :', '  ERROR     : ' || count(*) FILTER (WHERE level = 'ERROR'), '  WARN      : ' || count(*) FILTER (WHERE level = 'WARN')] AS parts FROM m)
SELECT CAST(i AS BIGINT) AS place, parts[i] AS line FROM (SELECT parts, unnest(generate_series(1, len(parts))) AS i FROM r)"""
)
def stats_lines(spark, sf):
    log = log_kv(spark, sf)
    return tables.stats_lines(rows.stats(log, rows.level_range(log, "warn")))


@query("WITH t AS ({text}), s AS (SELECT file_id, lineno, line, (CASE WHEN regexp_matches(line, '(?i)the') THEN 2.0 ELSE 0 END) + (CASE WHEN regexp_matches(line, '(?i)license') THEN 5.0 ELSE 0 END) AS score FROM t) SELECT file_id::VARCHAR AS file, lineno, printf('%6d  %7.2f  ', lineno, score) || line AS line FROM s WHERE score >= 3")
def score_lines(spark, sf):
    scored = rows.score(log_text(spark, sf), {"the": 2.0, "license": 5.0}, 3.0)
    return scored.select("file", "lineno", report.scored(F.col("line"), F.col("lineno"), F.col("score")).alias("line"))


@query(
    """WITH l AS ({kv}), s AS (SELECT lineno, line, date_trunc('second', ts) AS t FROM l), m AS (SELECT lineno, line, epoch_ms(t) - epoch_ms(min(t) OVER ()) AS e, epoch_ms(t) - epoch_ms(lag(t) OVER (ORDER BY lineno)) AS d FROM s)
SELECT lineno, printf('[%6d] [+%10sms] [d%10sms] ', lineno, coalesce(printf('%.1f', CAST(e AS DOUBLE)), '      -'), coalesce(printf('%.1f', CAST(d AS DOUBLE)), '      -')) || line AS line FROM m"""
)
def annotate_lines(spark, sf):
    a = ordered.annotate(log_kv(spark, sf), block=30_000)
    return a.select("lineno", report.annotated(F.col("line"), F.col("lineno"), F.col("elapsed_ms"), F.col("delta_ms")).alias("line"))


@query(
    """WITH l AS ({kv}), m AS (SELECT lineno, line, bool_or(event_type = 'error') OVER (ORDER BY lineno ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM l),
g AS (SELECT lineno, line, lineno - lag(lineno) OVER (ORDER BY lineno) > 1 AS gap FROM m WHERE near)
SELECT lineno, 1 AS part, lineno || ':' || line AS line FROM g UNION ALL SELECT lineno, 0, '--' FROM g WHERE gap"""
)
def context_lines(spark, sf):
    return tables.context_lines(ordered.context(log_kv(spark, sf), "ERROR", before=2, after=1, block=30_000), show_lineno=True).drop("file")


@query("WITH l AS ({kv}) SELECT lineno, line FROM l WHERE lineno > 400")
def from_line(spark, sf):
    return rows.from_line(log_kv(spark, sf), 400).select("lineno", "line")


@query("WITH l AS (SELECT *, CASE WHEN form IN (0, 1, 2, 6, 7) THEN 'iso8601' WHEN form = 3 THEN 'apache' WHEN form = 4 THEN 'syslog' WHEN form = 8 THEN 'epoch' END AS f FROM ({mixed})), s AS (SELECT * FROM l WHERE line <> '' ORDER BY lineno LIMIT 20) SELECT f AS format, count(*) AS votes FROM s WHERE f IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, min(lineno) LIMIT 1")
def vote_format(spark, sf):
    return rows.vote_format(log_mixed(spark, sf))


def _places(lines: DataFrame, order: list) -> DataFrame:
    """Each line's number and its place in an order; the lines themselves are not sorted with their keys."""
    keys, by = keyed(lines, order)
    return ordered.numbered(keys.drop("file", "line"), *by, name="place").select("lineno", "place")


@query("WITH l AS ({kv}) SELECT lineno, row_number() OVER (ORDER BY v DESC, lineno) AS place FROM l")
def sort_json_numbers(spark, sf):
    return _places(log_json(spark, sf), rows.field_order("value", reverse=True))


@query(
    """WITH l AS (SELECT (lineno - 1) // 50 AS part, (lineno - 1) % 50 + 1 AS n, CASE WHEN form IN (0, 1, 2, 6, 7) THEN 'iso8601' WHEN form = 3 THEN 'apache' WHEN form = 4 THEN 'syslog' WHEN form = 8 THEN 'epoch' END AS f FROM ({mixed}) WHERE lineno % 3 <> 0 OR lineno % 10 IN (4, 5)),
v AS (SELECT part, f, count(*) AS votes, min(n) AS first FROM l WHERE n <= 20 AND f IS NOT NULL GROUP BY 1, 2)
SELECT CAST(part AS VARCHAR) AS file, f AS format, votes FROM v QUALIFY row_number() OVER (PARTITION BY part ORDER BY votes DESC, first) = 1"""
)
def vote_formats(spark, sf):
    mixed = log_mixed(spark, sf).filter("lineno % 3 <> 0 or lineno % 10 in (4, 5)")
    return rows.vote_formats(mixed.select(F.floor((F.col("lineno") - 1) / 50).cast("string").alias("file"), ((F.col("lineno") - 1) % 50 + 1).alias("lineno"), "line"))


# -- lines with odd white space, nested and null fields, and what depends on them -----------------------------------------

ODD_SQL = """SELECT event_id + 1 AS lineno, event_id % 8 AS form, ts, user_id, event_type, CASE event_id % 8
    WHEN 0 THEN 'user=' || user_id || chr(9) WHEN 1 THEN ' user=' || user_id || chr(13) WHEN 2 THEN '   ' WHEN 3 THEN chr(9)
    WHEN 4 THEN '{"x": {"u": "5"}, "u": "' || user_id || '", "n": null}' WHEN 5 THEN '' WHEN 6 THEN 'x= y=' || user_id % 3
    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' user=' || user_id || '  ' END AS line FROM events"""


def log_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines with tabs, returns and blanks at their ends, nested and null fields, empty values."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    user = F.col("user_id").cast("string")
    forms = [
        ("user=", user, "\t"), (" user=", user, "\r"), ("   ",), ("\t",), ('{"x": {"u": "5"}, "u": "', user, '", "n": null}'), ("",),
        ("x= y=", (F.col("user_id") % 3).cast("string")), (F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), " user=", user, "  "),
    ]
    line = F.lit("")
    for i, parts in enumerate(forms):
        line = F.when(F.col("event_id") % 8 == i, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))).otherwise(line)
    return e.select(F.lit("odd.log").alias("file"), (F.col("event_id") + 1).alias("lineno"), line.alias("line"))


def odd(sql: str):
    return query("WITH l AS (" + ODD_SQL + ") " + sql)


@odd("SELECT trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS value, count(*) AS count FROM l WHERE trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> '' GROUP BY 1")
def count_lines_odd(spark, sf):
    return rows.count_lines(log_odd(spark, sf))


@odd("""SELECT lineno, CASE WHEN form = 4 THEN '{"x":{"u":"5"},"u":' || user_id || ',"n":null}' ELSE line END AS out FROM l""")
def cast_nested(spark, sf):
    return log_odd(spark, sf).select("lineno", text.cast_field(F.col("line"), "u", "int").alias("out"))


@odd("SELECT lineno, line FROM l WHERE line <> '' AND (form <> 7 OR date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-10 12:00:00')")
def time_range_untimed(spark, sf):
    return rows.time_range(log_odd(spark, sf), datetime(2024, 1, 3), datetime(2024, 1, 10, 12), keep_untimed=True).select("lineno", "line")


@odd("SELECT lineno, CASE WHEN form = 4 THEN '[' || user_id || '|None|{nope}]' ELSE '[{u}|{n}|{nope}]' END AS out FROM l")
def template_null(spark, sf):
    return log_odd(spark, sf).select("lineno", text.render(F.col("line"), F.col("lineno"), "[{u}|{n}|{nope}]").alias("out"))


@odd("SELECT value, count(*) AS count FROM (SELECT unnest(['', CAST(user_id % 3 AS VARCHAR)]) AS value FROM l WHERE form = 6) GROUP BY 1")
def count_pattern_empty(spark, sf):
    return rows.count_pattern(log_odd(spark, sf), r"[xy]=(\d*)")


@odd("SELECT CASE WHEN form IN (0, 1, 7) THEN CAST(user_id AS VARCHAR) WHEN form = 6 THEN CAST(user_id % 3 AS VARCHAR) ELSE 'default' END AS bucket, count(*) AS count FROM l GROUP BY 1")
def split_buckets(spark, sf):
    return log_odd(spark, sf).groupBy(logs.bucket_key(F.col("line"), pattern=r"(\w+)=(?P<n>\d+ ?)").alias("bucket")).count()


_SIDES = """WITH l AS ({kv}), a AS (SELECT lineno, line, line[21:] AS k FROM l), b AS (SELECT lineno, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') || '  ' || CASE WHEN event_type = 'error' THEN 'new ' ELSE '' END || line[21:] AS line, CASE WHEN event_type = 'error' THEN 'new ' ELSE '' END || line[21:] AS k FROM l),
m AS (SELECT k, max(lineno) AS r FROM b GROUP BY k)"""


def _shifted(spark, sf):
    """The events' log, and the same with other times and with some lines changed."""
    left = log_kv(spark, sf)
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_id") + 1).alias("lineno"), F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm:ss").alias("t"), F.when(F.col("event_type") == "error", "new ").otherwise("").alias("mark"))
    right = left.join(e, "lineno").select(F.lit("b").alias("file"), "lineno", F.concat("t", F.lit("  "), "mark", F.substring("line", 21, 1 << 20)).alias("line"))
    return left, right


@query(
    _SIDES
    + """ SELECT CASE WHEN m.r IS NULL THEN 'left' ELSE 'both' END AS side, a.lineno AS lineno_left, m.r AS lineno_right, a.line AS text FROM a LEFT JOIN m ON a.k = m.k
UNION ALL SELECT 'right', NULL, b.lineno, b.line FROM b WHERE b.lineno NOT IN (SELECT r FROM m WHERE k IN (SELECT k FROM a))"""
)
def diff_ignoring_times(spark, sf):
    return ordered.diff(*_shifted(spark, sf), ignore_timestamps=True)


@query(_SIDES + " SELECT 'left' AS side, a.lineno AS lineno_left, CAST(NULL AS BIGINT) AS lineno_right, '< ' || a.line AS line FROM a WHERE a.k NOT IN (SELECT k FROM m)")
def diff_text(spark, sf):
    return tables.diff_lines(ordered.diff(*_shifted(spark, sf), ignore_timestamps=True), only="left")


@query("WITH l AS ({kv}) SELECT lineno, line FROM l WHERE CAST('0x' || substr(md5('7:events.log:' || lineno), 1, 13) AS BIGINT) < CAST(floor(0.1 * 4503599627370496) AS BIGINT)")
def sample_fraction(spark, sf):
    return rows.fraction(log_kv(spark, sf), 0.1, 7).select("lineno", "line")


@query("WITH l AS ({kv}) SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS count FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def count_top(spark, sf):
    return rows.top(rows.count_field(log_kv(spark, sf), "user"), 15)


# -- the same on streams --------------------------------------------------------------------------------------------------


def _fed(spark: SparkSession, lines: DataFrame, start: Callable[[DataFrame, str], StreamingQuery]) -> str:
    """Feeds the lines as a stream of micro-batches to what ``start`` makes of it in a folder, in four runs with restarts between them.

    The lines are dealt into four parts by number, so that each file is cut, in one distributed write; a run takes the part that has come. All
    lies in the shared checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows_ = lines.select("file", "lineno", "line")
    last = rows_.agg(F.max("lineno")).first()[0] or 0
    part = sum((F.when(F.col("lineno") > last * n // 4, 1).otherwise(0) for n in (1, 2, 3)), F.lit(0))
    rows_.filter(F.col("lineno").between(1, last)).withColumn("part", part).write.partitionBy("part").parquet(f"{folder}/dealt")
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}{name}")
    fs = path("").getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(path(""))
    fs.mkdirs(path("/in"))
    for n in range(4):
        if fs.exists(path(f"/dealt/part={n}")):
            fs.rename(path(f"/dealt/part={n}"), path(f"/in/part={n}"))
        else:
            fs.mkdirs(path(f"/in/part={n}"))
        start(spark.readStream.schema(rows_.schema).parquet(f"{folder}/in/*"), folder).awaitTermination()
    return folder


def _streamed(spark: SparkSession, lines: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``operator`` gives of the lines as a stream."""

    def start(stream: DataFrame, folder: str) -> StreamingQuery:
        return operator(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()

    return spark.read.parquet(f"{_fed(spark, lines, start)}/out")


def _by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files of 16 groups of users, numbered as in the whole log."""
    return log_kv(spark, sf_dir).withColumn("file", F.concat(F.lit("u"), F.regexp_extract("line", r"user=(\d+)", 1).cast("long") % 16))


_USERS = "WITH l AS (SELECT *, 'u' || user_id % 16 AS file, date_trunc('second', ts) AS t FROM ({kv}))"


@query(_USERS + " SELECT file, lineno, CAST(epoch_ms(t) - epoch_ms(first_value(t) OVER (PARTITION BY file ORDER BY lineno)) AS DOUBLE) AS elapsed_ms, CAST(epoch_ms(t) - epoch_ms(lag(t) OVER (PARTITION BY file ORDER BY lineno)) AS DOUBLE) AS delta_ms FROM l")
def live_annotate(spark, sf):
    return _streamed(spark, _by_user(spark, sf), lambda s: stateful.annotate(s, "lineno")).select("file", "lineno", "elapsed_ms", "delta_ms")


@query(_USERS.replace("SELECT *", "SELECT lineno, level || ' ' || event_type AS line").replace("date_trunc('second', ts)", "ts") + ", p AS (SELECT file, lineno, line, lag(line) OVER (PARTITION BY file ORDER BY lineno) AS before FROM l) SELECT file, lineno, line FROM p WHERE before IS NULL OR before <> line")
def live_dedupe_adjacent(spark, sf):
    return _streamed(spark, _short(spark, sf), lambda s: stateful.dedupe_adjacent(s, "lineno"))


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and type of each event alone, so that lines repeat."""
    return _by_user(spark, sf_dir).withColumn("line", F.concat_ws(" ", F.split("line", " ")[1], F.regexp_extract("line", r"type=(\w+)", 1)))


@query(
    """WITH RECURSIVE l AS (SELECT 'u' || user_id % 16 AS file, lineno, level || ' ' || event_type AS line, row_number() OVER (PARTITION BY user_id % 16 ORDER BY lineno) AS n FROM ({kv})),
c(file, n, lineno, line, seen, kept) AS (SELECT file, n, lineno, line, [line], true FROM l WHERE n = 1 UNION ALL
  SELECT l.file, l.n, l.lineno, l.line, CASE WHEN list_contains(c.seen, l.line) THEN c.seen ELSE list_append(c.seen, l.line)[-3:] END, NOT list_contains(c.seen, l.line) FROM c JOIN l ON l.file = c.file AND l.n = c.n + 1)
SELECT file, lineno, line FROM c WHERE kept"""
)
def live_dedupe_cached(spark, sf):
    return _streamed(spark, _short(spark, sf), lambda s: stateful.dedupe_cached(s, 3, "lineno"))


@query(
    """WITH RECURSIVE l AS (SELECT 'u' || user_id % 16 AS file, lineno, date_trunc('second', ts) AS t, row_number() OVER (PARTITION BY user_id % 16 ORDER BY lineno) AS n FROM ({kv})),
c(file, n, lineno, s, chunk) AS (SELECT file, n, lineno, t, 0 FROM l WHERE n = 1 UNION ALL
  SELECT l.file, l.n, l.lineno, CASE WHEN l.t - c.s >= INTERVAL 6 HOUR THEN l.t ELSE c.s END, CASE WHEN l.t - c.s >= INTERVAL 6 HOUR THEN c.chunk + 1 ELSE c.chunk END FROM c JOIN l ON l.file = c.file AND l.n = c.n + 1)
SELECT file, lineno, CAST(chunk AS BIGINT) AS chunk FROM c"""
)
def live_chunks(spark, sf):
    return _streamed(spark, _by_user(spark, sf), lambda s: stateful.chunk_seconds(s, 21_600, "lineno")).select("file", "lineno", "chunk")


@query(
    """WITH t AS (SELECT lineno, date_trunc('second', ts) AS t, 'u' || user_id % 16 AS file, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || level AS line, level FROM ({kv})),
n AS (SELECT *, CASE WHEN level = lag(level) OVER w THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY file ORDER BY lineno)),
i AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY lineno) AS island FROM n),
r AS (SELECT file, island, min(lineno) AS lineno, arg_min(line, lineno) AS line, count(*) AS n, arg_max(t, lineno) AS t FROM i GROUP BY 1, 2),
e AS (SELECT file, max(island) AS island FROM r GROUP BY file)
SELECT r.file, r.lineno, CASE WHEN n > 1 THEN line || '  [repeated ' || n || 'x]' ELSE line END AS line, n AS repeated FROM r JOIN e ON e.file = r.file WHERE r.island < e.island"""
)
def live_squash(spark, sf):
    """Runs of one level; a file's last run is still open, as the watermark comes nowhere near the wait."""
    log = _by_user(spark, sf).withColumn("line", F.concat_ws(" ", F.replace(F.split("line", " ")[0], F.lit("T"), F.lit(" ")), F.split("line", " ")[1]))
    return _streamed(spark, log, lambda s: stateful.squash(s, 2, 60 * 86_400, "0 seconds", "lineno"))


@query("WITH l AS ({kv}) SELECT 'j' || user_id % 16 AS file, lineno * 10 AS lineno, '{\"ts\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '\",\"type\":\"' || event_type || '\",\"user\":' || user_id || ',\"value\":' || v || '}' AS line FROM l")
def live_compact_json(spark, sf):
    file = F.concat(F.lit("j"), F.regexp_extract("line", r'"user":(\d+)', 1).cast("long") % 16)
    broken = log_json(spark, sf).select(file.alias("file"), "lineno", F.posexplode(F.split("line", "(?<=,)")).alias("i", "line"))
    return _streamed(spark, broken.select("file", (F.col("lineno") * 10 + F.col("i")).alias("lineno"), "line"), lambda s: stateful.compact_json(s, 300, place="lineno"))


@query("WITH l AS ({kv}), n AS (SELECT 'f' || user_id % 3 AS file, row_number() OVER (PARTITION BY user_id % 3 ORDER BY lineno) AS lineno, date_trunc('second', ts) AS ets FROM l) SELECT file, lineno, ets, row_number() OVER (ORDER BY ets, lineno, file) AS rank FROM n")
def live_merge(spark, sf):
    """Three files merged while they come; what is held when the stream ends is released then."""
    log = log_kv(spark, sf).withColumn("file", F.concat(F.lit("f"), F.regexp_extract("line", r"user=(\d+)", 1).cast("long") % 3))
    files = ["f0", "f1", "f2"]
    folder = _fed(spark, log, lambda s, at: merging.merge(s, f"{at}/merge", files, place="lineno", trigger={"availableNow": True})) + "/merge"
    merging.finish(spark, folder)
    return merging.merged(spark, folder).select("file", "lineno", "ets", "rank")
