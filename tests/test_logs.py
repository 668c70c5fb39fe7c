import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fields, levels, text, timestamps
from tidemark.functions.regex import to_java
from tidemark.operators import ordered, rows
from tidemark.sources import logs
from tidemark.streaming.follow import FollowSource, follow, live_rate, run_until


def log(spark, *lines, file="a"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(lines, 1)], "file string, lineno long, line string")


def one(spark, column, *lines):
    return [r[0] for r in log(spark, *lines).orderBy("lineno").select(column(F.col("line"))).collect()]


def nos(df):
    return sorted(r.lineno for r in df.collect())


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("2024-01-15T13:45:00.123", datetime(2024, 1, 15, 13, 45, 0, 123000)),
        ("15/Jan/2024:13:45:00", datetime(2024, 1, 15, 13, 45)),
        ('{"timestamp": "2024-03-01T10:00:00", "msg": "hello"}', datetime(2024, 3, 1, 10)),
        ('{"ts": "2024-03-01 08:30:00", "level": "INFO"}', datetime(2024, 3, 1, 8, 30)),
        ("2024-06-20T22:15:00Z [ERROR] disk full", datetime(2024, 6, 20, 22, 15)),
        ("no timestamp here", None),
        ("2024-01-15T13:45:00+00:00 x", None),
        ("2024-01-15 13:45:00.999 x", datetime(2024, 1, 15, 13, 45)),
        ('{"timestamp": 1705312245, "time": "2024-01-01T00:00:00"}', None),
        ("Jan 15 13:45:00 host", datetime(1900, 1, 15, 13, 45)),
        ("2024-02-30T00:00:00 x", None),
    ],
)
def test_timestamps(spark, line, want):
    assert one(spark, timestamps.extract, line) == [want]


def test_filters(spark):
    t = log(spark, "2024-01-01T08:00:00 a", "2024-01-01T09:00:00 b", "2024-01-01T10:00:00 c", "2024-01-01T11:00:00 d", "untimed", "")
    lo, hi = datetime(2024, 1, 1, 9), datetime(2024, 1, 1, 10)
    assert nos(rows.time_range(t, lo, hi)) == [2, 3] and nos(rows.time_range(t, keep_untimed=True)) == [1, 2, 3, 4, 5]
    w = log(spark, "2024-01-01T11:59:30 a", "2024-01-01T11:58:59 b", "2024-01-01T11:59:00 c", "2024-01-01T12:00:00 d", "untimed")
    assert nos(rows.last_window(w, 60, datetime(2024, 1, 1, 12))) == [1, 3, 4, 5]
    lv = log(spark, "DEBUG a", "INFO b", "WARNING c", "ERROR d", "FATAL e", "none")
    assert nos(rows.level_range(lv, "error")) == [4, 5] and nos(rows.level_range(lv, "info", "warn")) == [2, 3]
    assert nos(rows.level_range(lv, "bogus")) == [1, 2, 3, 4, 5] and nos(rows.level_range(lv, "info", "bogus")) == []
    ten = log(spark, *(f"line {i}" for i in range(1, 11)))
    assert nos(rows.every(ten, 5)) == [5, 10] and nos(rows.clip(ten, 3, 6)) == [3, 4, 5, 6]
    assert nos(rows.head(ten, 0)) == [] and nos(rows.tail(ten, 2)) == [9, 10]
    b = log(spark, "aaa", "bbb", "ccc")
    assert nos(ordered.byte_limit(b, 8, block=1)) == [1, 2]
    assert [r.line for r in ordered.byte_limit(log(spark, "aaa", "bbbbbbb"), 6, cut=True, block=1).orderBy("lineno").collect()] == ["aaa", "bb"]
    c = log(spark, "a", "b", "ERROR", "d", "e", "ERROR", "g")
    for block in (1, 2, 100):
        assert [(r.lineno, r.gap) for r in ordered.context(c, "ERROR", block=block).orderBy("lineno").collect()] == [(3, True), (6, True)]
        assert nos(ordered.context(c, "ERROR", 1, 1, block=block)) == [2, 3, 4, 5, 6, 7]


def test_fields(spark):
    assert one(spark, lambda c: fields.field(c, "msg"), 'msg="hello world" level=WARN', '{"msg": "x"}', '{"a": 1} msg=2') == ["hello world", "x", "2"]
    assert one(spark, lambda c: fields.field(c, "http.status"), "http.status=200,") == ["200"]
    assert one(spark, lambda c: fields.field(c, "a", "tokens"), 'a="b c" a=2,', "b=1") == ["2,", None]
    assert one(spark, levels.extract, "a Warn b", "err", "x") == ["warning", "error", None]
    p = log(spark, '{"status":200,"ms":100}', '{"status":200,"ms":200}', '{"status":500,"ms":50}', '{"status":500}')
    assert [tuple(r) for r in rows.pivot(p, "status", "ms").orderBy("key").collect()] == [("200", 2, 300.0, 150.0), ("500", 2, 50.0, 25.0)]
    assert {(r.value, r["count"]) for r in rows.count_pattern(log(spark, "level=INFO", "level=ERROR", "level=INFO"), r"level=(\w+)").collect()} == {("INFO", 2), ("ERROR", 1)}
    with pytest.raises(Exception, match="parenthesis|unterminated"):
        to_java("(")


def test_changes_of_lines(spark):
    assert one(spark, lambda c: text.truncate(c, 10), "a" * 50, "short") == ["a" * 7 + "...", "short"]
    assert one(spark, lambda c: text.mask_pattern(c, r"token=(\S+)", "***", 1), "token=abc123 end token=x") == ["token=*** end token=***"]
    assert one(spark, lambda c: text.mask_pattern(c, r"\d+", "$1"), "user=42 count=7") == ["user=$1 count=$1"]
    assert one(spark, lambda c: text.redact(c, ["ipv4"])[0], "Connected from 192.168.1.1 ok") == ["Connected from [REDACTED] ok"]
    assert one(spark, lambda c: text.redact(c, ["ipv4"])[1], "1.1.1.1 and 2.2.2.2") == [2]
    assert one(spark, lambda c: text.strip_prefix(c, "INFO:"), "   INFO: msg") == ["msg"]
    assert one(spark, text.strip_ansi, "\x1b[31mERROR\x1b[0m something") == ["ERROR something"]
    assert one(spark, lambda c: text.render(c, F.col("lineno"), "[{level}] {msg} {missing}"), "level=WARN msg=disk_full") == ["[WARN] disk_full {missing}"]
    assert one(spark, lambda c: text.cast_field(c, "n", "int"), '{"n":"not-a-number"}', '{"n":"12"}', "plain") == ['{"n":"not-a-number"}', '{"n":12}', "plain"]
    assert one(spark, lambda c: text.convert(c, "json"), "some plain log line") == ['{"message": "some plain log line"}']
    assert one(spark, lambda c: text.normalize(c), 'msg="hello world" code=42') == ['{"msg":"hello world","code":"42"}']
    assert one(spark, lambda c: text.rename(c, {"msg": "message"}), '{"msg":"hello","level":"info"}') == ['{"message":"hello","level":"info"}']


def test_neighbours(spark):
    q = log(spark, "conn 1", "conn 2", "conn 3", "done", "err 1", "err 2")
    for block in (1, 2, 100):
        assert [r.line for r in ordered.squash(q, block=block).orderBy("lineno").collect()] == ["conn 1  [repeated 3x]", "done", "err 1  [repeated 2x]"]
        assert nos(ordered.dedupe_adjacent(log(spark, "a", "a", "b", "a"), block=block)) == [1, 3, 4]
        t = log(spark, "x", "2024-01-01T00:00:00", "2024-01-01T00:00:01", "y", "2024-01-01T00:00:03")
        assert [(r.elapsed_ms, r.delta_ms) for r in ordered.annotate(t, block=block).orderBy("lineno").collect()] == [(None, None), (0, None), (1000, 1000), (None, None), (3000, 2000)]
        m = log(spark, "2024-01-01T10:00:00", "2024-01-01T10:02:00").unionByName(log(spark, "2024-01-01T10:01:00", "2024-01-01T10:03:00", file="b"))
        assert [(r.file, r.lineno) for r in ordered.merge(m, block=block).collect()] == [("a", 1), ("b", 1), ("a", 2), ("b", 2)]
    c = log(spark, *(f"2024-01-01T00:00:{s:02}" for s in (0, 5, 10, 15)))
    assert [r.chunk for r in ordered.chunk_seconds(c, 10).orderBy("lineno").collect()] == [0, 0, 1, 1]
    assert nos(ordered.dedupe_cached(log(spark, "a", "b", "c", "a"), 2)) == [1, 2, 3, 4]
    assert nos(ordered.dedupe_cached(log(spark, "a", "b", "a"), 2)) == [1, 2]
    j = ordered.compact_json(log(spark, "{", '  "level": "error",', '  "msg": "boom"', "}", "plain", "{", "broken"))
    assert [r.line for r in j.orderBy("lineno").collect()] == ['{"level":"error","msg":"boom"}', "plain", "{", "broken"]
    d = ordered.diff(log(spark, "x"), log(spark, "x", "x"))
    assert {tuple(r) for r in d.collect()} == {("both", 1, 2, "x"), ("right", None, 1, "x")}


def test_files(spark, tmp_path):
    (tmp_path / "app.log").write_text("three\nfour\n")
    (tmp_path / "app.log.1").write_text("two\n")
    with gzip.open(tmp_path / "app.log.2.gz", "wt") as f:
        f.write("one\n")
    got = logs.read_rotated(spark, str(tmp_path / "app.log")).orderBy("file_seq", "lineno").collect()
    assert [r.line for r in got] == ["one", "two", "three", "four"]
    big = tmp_path / "big.log"
    big.write_text("".join(f"{i}\n" for i in range(1, 200_001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        assert logs.read_log(spark, str(big)).filter("cast(line as long) <> lineno").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    counts = logs.split_log(log(spark, "level=a x", "level=b y", "z"), str(tmp_path / "split"), field="level")
    assert {tuple(r) for r in counts.collect()} == {("a", 1), ("b", 1), ("unknown", 1)}


def test_follow(spark, tmp_path):
    path = tmp_path / "live.log"
    path.write_text("old\n")
    query = follow(spark, str(path)).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        with path.open("a") as f:
            f.write("new 1\nnew 2\npart")
        query.processAllAvailable()
        assert [r.line for r in spark.table("live").orderBy("offset").collect()] == ["new 1", "new 2"]
    finally:
        query.stop()


def test_place_in_a_whole_sort(spark):
    log = spark.range(3000).select(F.lit("x").alias("file"), (F.col("id") + 1).alias("lineno"), F.concat(F.lit("user="), F.col("id") * 7 % 40).alias("line")).repartition(7)
    got = {r.lineno: r.place for r in ordered.numbered(log, *rows.field_order("user"), name="place").collect()}
    want = sorted(range(1, 3001), key=lambda n: (str((n - 1) * 7 % 40), n))
    assert got == {n: i for i, n in enumerate(want, 1)}
    assert ordered.numbered(log.limit(0), "lineno").count() == 0


def test_json_numbers_sort_by_value(spark):
    lines = ['{"n": 10}', '{"n": 9}', '{"n": "9"}', '{"n": "10"}', "n=2", '{"n": -1.5}', '{"m": 1}', "plain", '{"n": 9007199254740993}', '{"n": 9007199254740992}', '{"n": null}', '{"n": true}', "", '{"n": 1e300}']
    df = log(spark, *lines).repartition(3)
    assert [r.lineno for r in rows.sort_field(df, "n").collect()] == [7, 8, 11, 13, 6, 2, 1, 10, 9, 14, 4, 5, 3, 12]
    back = [r.lineno for r in rows.sort_field(df, "n", reverse=True).collect()]
    assert back == [12, 3, 5, 4, 14, 9, 10, 1, 2, 6, 7, 8, 11, 13]


def test_formats_by_vote(spark):
    iso, sys = "2024-01-15T13:45:00 x", "Jan 15 13:45:00 host x"
    df = log(spark, sys, "\t", iso, "", iso, sys, iso, file="a").unionByName(log(spark, "", "", iso, file="b")).unionByName(log(spark, "none", file="c"))
    assert {tuple(r) for r in rows.vote_formats(df, 6).collect()} == {("a", "syslog", 2), ("b", "iso8601", 1)}
    assert {tuple(r) for r in rows.vote_formats(df, 7).collect()} == {("a", "iso8601", 3), ("b", "iso8601", 1)}
    assert rows.vote_formats(df, 2).filter("file = 'b'").count() == 0 and rows.vote_formats(df.limit(0)).count() == 0
    assert [tuple(r) for r in rows.vote_format(df.filter("file = 'a'"), 3).collect()] == [("iso8601", 2)]


def test_whole_queries_return_every_line(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    found = entry.queries()
    for name in ("sort_field_whole", "sort_time_reversed_whole"):
        assert sorted(r.place for r in found[name](spark, sf).collect()) == list(range(1, n + 1))
    lines = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.split("text", "\n"))).count()
    diff = found["diff_sources_whole"](spark, sf)
    assert diff.filter("lineno_left is not null").count() == lines and diff.filter("side <> 'left'").select("lineno_right").distinct().count() == lines


def test_follow_reads_a_line_longer_than_a_batch(tmp_path):
    path = tmp_path / "long.log"
    path.write_bytes(b"a\n" + b"x" * 95 + b"\nb\n" + b"y" * 50)
    reader = FollowSource({"path": str(path), "fromStart": "true", "maxBytes": "10"}).simpleStreamReader(None)
    at, lines = reader.initialOffset(), []
    for _ in range(8):
        rows, end = reader.read(at)
        got = list(rows)
        assert got == list(reader.readBetweenOffsets(at, end))
        lines, at = lines + [r[2] for r in got], end
    assert lines == ["a", "x" * 95, "b"] and at["at"] == 100
    with path.open("ab") as f:
        f.write(b"\n")
    assert [r[2] for r in reader.read(at)[0]] == ["y" * 50]


def test_follow_shared_deals_each_line_to_one_range(tmp_path):
    path = tmp_path / "shared.log"
    path.write_bytes(b"a\n" + b"x" * 95 + b"\r\n\nb\n" + b"y" * 50)
    for most in (1, 2, 7, 10, 99, 100, 1000):
        reader = FollowSource({"path": str(path), "fromStart": "true", "shared": "true", "maxBytes": str(most)}).streamReader(None)
        end = reader.latestOffset()
        rows = [r for p in reader.partitions(reader.initialOffset(), end) for r in reader.read(p)]
        assert end["at"] == 102 and [r[1:] for r in rows] == [(0, "a"), (2, "x" * 95), (99, ""), (100, "b")]
    assert reader.partitions(reader.mark(str(path), 152, 0), end) == []  # within a line still being written
    path.write_bytes(b"new\n")
    assert [r[2] for p in reader.partitions(end, reader.latestOffset()) for r in reader.read(p)] == ["new"]
    path.write_bytes(b"")
    empty = reader.latestOffset()
    assert empty["at"] == 0 and reader.partitions(empty, empty) == []


def rotate(path, how):
    """Moves what ``path`` holds to ``path.1``, as log rotation does; older ones move up."""
    for n in range(9, 0, -1):
        for end in ("", ".gz"):
            old = path.with_name(f"{path.name}.{n}{end}")
            if old.exists():
                old.rename(path.with_name(f"{path.name}.{n + 1}{end}"))
    first = path.with_name(f"{path.name}.1")
    if how == "copy":
        first.write_bytes(path.read_bytes())
        path.write_bytes(b"")
    else:
        path.rename(first)
        path.write_bytes(b"")
    if how == "gz":
        with gzip.open(f"{first}.gz", "wb") as f:
            f.write(first.read_bytes())
        first.unlink()


@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("how", ["rename", "copy", "gz"])
@pytest.mark.parametrize("most", [7, 1000])
def test_follow_across_rotation(tmp_path, shared, how, most):
    path, written = tmp_path / "app.log", []
    path.write_bytes(b"")
    source = FollowSource({"path": str(path), "fromStart": "true", "maxBytes": str(most), "shared": str(shared).lower()})
    reader = source.streamReader(None) if shared else source.simpleStreamReader(None)

    def append(n, end=b"\n"):
        for _ in range(n):
            written.append(f"line {len(written)}")
            with path.open("ab") as f:
                f.write(written[-1].encode() + (end if _ == n - 1 else b"\n"))

    def step(at):
        if shared:
            end = reader.latestOffset()
            return [r for p in reader.partitions(at, end) for r in reader.read(p)], end
        rows, end = reader.read(at)
        rows = list(rows)
        assert rows == list(reader.readBetweenOffsets(at, end))
        return rows, end

    at, got = reader.initialOffset(), []
    # what is written ahead of each rotation, with a line feed at its end or not, and how often the file is read then
    for before, end, reads, rotations, after in ((3, b"\n", 1, 1, 2), (2, b"\n", 0, 1, 9), (4, b"", 1, 2, 1), (0, b"\n", 1, 1, 30)):
        append(before, end)
        for _ in range(reads):
            rows, at = step(at)
            got += rows
        for i in range(rotations):
            rotate(path, how)
            if i + 1 < rotations:
                append(2)
        append(after)  # so it may have outgrown the offset
    for _ in range(200):
        rows, new = step(at)
        got += rows
        if new == at:
            break
        at = new
    assert [r[2] for r in got] == written
    if not shared:
        assert [r[1] for r in got] == sorted({r[1] for r in got})


def test_follow_of_a_file_emptied_or_deleted(tmp_path):
    path = tmp_path / "app.log"
    path.write_bytes(b"one\ntwo\n")
    reader = FollowSource({"path": str(path)}).simpleStreamReader(None)
    at = reader.initialOffset()
    path.write_bytes(b"three\nfour\nfive\n")  # longer than before, with no copy of what it held
    rows, at = reader.read(at)
    assert [r[1:] for r in rows] == [(8, "three"), (14, "four"), (19, "five")]
    path.unlink()
    assert list(reader.read(at)[0]) == [] and reader.read(at)[1] == at
    path.write_bytes(b"six\n")
    assert [r[2] for r in reader.read(at)[0]] == ["six"]


def test_follow_ends(spark, tmp_path):
    path = tmp_path / "ends.log"
    path.write_text("".join(f"l{i}\n" for i in range(10)))
    few = follow(spark, str(path), from_start=True, lines=4).writeStream.format("memory").queryName("few").option("checkpointLocation", str(tmp_path / "c")).start()
    assert run_until(few, lines=4, timeout=60) >= 4 and not few.isActive
    assert [r.line for r in spark.table("few").orderBy("offset").collect()] == ["l0", "l1", "l2", "l3"]
    every = follow(spark, str(path), from_start=True).writeStream.format("memory").queryName("every").option("checkpointLocation", str(tmp_path / "d")).start()
    every.processAllAvailable()
    path.unlink()
    assert run_until(every, path=str(path), timeout=60) == 10 and not every.isActive


def test_live_rate(spark, tmp_path):
    path = tmp_path / "rate.log"
    path.write_text("2024-01-01T00:00:05 a\n2024-01-01T00:00:50 b\nno time\n2024-01-01T00:01:10 c\n2024-01-01T01:00:00 d\n")
    query = live_rate(follow(spark, str(path), from_start=True), 60, "1 minute").writeStream.format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        got = {str(r.bucket): r["count"] for r in spark.table("rates").collect()}
    finally:
        query.stop()
    assert got == {"2024-01-01 00:00:00": 2, "2024-01-01 00:01:00": 1}


def test_follow_shared_as_a_stream(spark, tmp_path):
    path = tmp_path / "live.log"
    path.write_text("old\n")
    query = follow(spark, str(path), shared=True).writeStream.format("memory").queryName("live_shared").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        for more in ("new 1\nnew 2\npart", " done\n"):
            with path.open("a") as f:
                f.write(more)
            query.processAllAvailable()
        assert [r.line for r in spark.table("live_shared").orderBy("offset").collect()] == ["new 1", "new 2", "part done"]
    finally:
        query.stop()


def test_sort_keys_are_columns(spark):
    """A sort over expressions would look for times and fields anew at each comparison."""
    df = spark.createDataFrame([("a", 1, "x=1"), ("a", 2, '{"x": 3}')], "file string, lineno long, line string")
    for got in (rows.sort_time(df), rows.sort_field(df, "x"), rows.sort_field(df, "x", reverse=True, numeric=True)):
        sorts = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Sort [" in x]
        assert sorts and all("(" not in x and "CASE" not in x for x in sorts)
        assert got.columns == df.columns
