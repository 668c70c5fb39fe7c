"""State that runs through a file, in blocks: held against plain loops over all lines."""

import json
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tidemark.functions import report, text
from tidemark.functions.text import list_formats, parse_size, rename, strip
from tidemark.operators import carried, ordered, tables
from tidemark.sources.logs import write_lines, write_merged


def frame(spark, files):
    return spark.createDataFrame([(f, i, x) for f, lines in files.items() for i, x in enumerate(lines, 1)], "file string, lineno long, line string").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[1]))


def stamp(second):
    return f"2024-03-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d} x"


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_chunks_by_time(spark, block):
    r, files = random.Random(block), {}
    for f in "abc":
        at, lines = 0, []
        for _ in range(60):
            at = max(0, at + r.choice([0, 1, 5, 20, -7]))  # not in order
            lines.append(stamp(at) if r.random() < 0.8 else "no time")
        files[f] = lines
    files["d"] = ["none", "at all"]
    want = []
    for f, lines in files.items():
        start, chunk = None, 0
        for i, x in enumerate(lines, 1):
            if x.endswith(" x"):
                h, m, s = map(int, x[11:19].split(":"))
                now = h * 3600 + m * 60 + s
                if start is None:
                    start = now
                elif now - start >= 30:
                    start, chunk = now, chunk + 1
            want.append((f, i, x, chunk))
    assert rows(ordered.chunk_seconds(frame(spark, files), 30, block=block)) == sorted(want)
    assert ordered.chunk_seconds(frame(spark, files).limit(0), 30).count() == 0


def compacted(lines):
    """One line after the other, as a reader would."""
    out, held, depth = [], [], 0
    close = lambda: [(held[0][0], json.dumps(v[0], separators=(",", ":")))] if (v := parsed("".join(x for _, x in held))) else list(held)
    for i, x in enumerate(lines, 1):
        if not held and not x.lstrip().startswith(("{", "[")):
            out.append((i, x))
            continue
        held.append((i, x))
        depth += sum(x.count(c) for c in "{[") - sum(x.count(c) for c in "}]")
        if depth <= 0:
            out += close()
            held, depth = [], 0
    return out + (close() if held else [])


def parsed(text):
    try:
        return [json.loads(text)]
    except ValueError:
        return None


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_json_over_lines(spark, block):
    r, files = random.Random(block + 7), {}
    for f in "abcdef":
        lines = []
        for _ in range(25):
            value = {"k": r.randint(0, 9), "é": [r.random() < 0.5, {"x": None}], "s": "a b"}
            lines += r.choice([json.dumps(value, indent=1).split("\n"), [json.dumps(value)], ["plain"], ["}} early"], ["[1,", "2", "] ]"], [" { broken", "}"], ["", "  [3]"]])
        files[f] = lines + r.choice([[], ["{ never", "closed"]])
    got = rows(ordered.compact_json(frame(spark, files), block=block))
    assert got == sorted((f, i, x) for f, lines in files.items() for i, x in compacted(lines))
    kept = ordered.compact_json(frame(spark, {"a": ["x", "[", "1", "2"]}), most_bytes=2)  # never closed
    assert [x for _, _, x in rows(kept)] == ["x", "[", "1", "2"]
    with pytest.raises(Exception, match="begins at line 2 of a"):
        ordered.compact_json(frame(spark, {"a": ["x", "[", "1", "]"]}), most_bytes=2).collect()


def admitted(files, size):
    want = []
    for f, lines in files.items():
        seen = OrderedDict()
        for i, x in enumerate(lines, 1):
            if x not in seen:
                if len(seen) >= size:
                    seen.popitem(last=False)
                seen[x] = None
                want.append((f, i, x))
    return sorted(want, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_bounded_memory(spark, block):
    r = random.Random(3)
    files = {f: [r.choice("abcdefgh") * r.randint(1, 2) for _ in range(50)] for f in ("x", "y")} | {"z": ["only"]}
    assert rows(ordered.dedupe_cached(frame(spark, files), 5, block=block)) == admitted(files, 5)


@pytest.mark.parametrize("size", [1, 3, 8])
def test_bounded_memory_that_turns_over_slowly(spark, size):
    """Null lines, memories that are just too small, and a line driven out now and then, all the way through a file."""
    r = random.Random(size)
    slow = [None if i % 17 == 0 else str(i // 40 + r.randrange(size)) for i in range(160)]
    files = {"slow": slow, "ring": [str(i % (size + 1)) for i in range(60)], "new": [str(i) for i in range(60)], "same": ["x"] * 60}
    assert rows(ordered.dedupe_cached(frame(spark, files), size, block=20)) == admitted(files, size)


def test_bounded_memory_with_few_lines_takes_few_rounds(spark, monkeypatch):
    """Three hundred blocks that hold what one memory holds: two stretches, so as many rounds and one that finds them agreed."""
    walks, rounds = [], carried._rounds

    def counted(spark):
        write = rounds(spark)
        return lambda df: walks.append(1) or write(df)

    monkeypatch.setattr(carried, "_rounds", counted)
    r = random.Random(1)
    files = {"f": [str(r.randrange(20)) for _ in range(900)]}
    assert rows(ordered.dedupe_cached(frame(spark, files), 20, block=3)) == admitted(files, 20)
    assert len(walks) <= 3


def test_bounded_memory_over_gaps_of_numbers(spark):
    lines = [(1, "a"), (2, "b"), (50, "a"), (51, "c"), (90, "b"), (91, "a")]
    df = spark.createDataFrame([("f", n, x) for n, x in lines], "file string, lineno long, line string")
    assert [r[1:] for r in rows(ordered.dedupe_cached(df, 3, block=4))] == [(1, "a"), (2, "b"), (51, "c")]
    assert ordered.dedupe_cached(df.limit(0), 3).count() == 0


def test_groups_of_one_block_are_joined_there(spark, monkeypatch):
    """Of many groups only those that cross an edge of blocks are gathered by their number."""
    monkeypatch.setattr(carried, "_rounds", lambda session: lambda df: seen.append(df.checkpoint()) or seen[-1])
    seen = []
    df = spark.createDataFrame([("a", i + 1, x) for i, x in enumerate(['{"n":', "1}", "plain", "{ not", "json }"] * 40)], "file string, lineno long, line string")
    got = {r.lineno: r.line for r in carried.compact_json(df, block=33).collect()}
    want = {i * 5 + n: x for i in range(40) for n, x in ((1, '{"n":1}'), (3, "plain"), (4, "{ not"), (5, "json }"))}
    assert got == want and seen[0].filter("_group is not null").count() <= 2 * (200 // 33)


def test_flat_json(spark):
    lines = ['{"a":{"b":1,"c":{}},"d":[1,[2],{"e":"é"}],"a.b":2}', "[1]", "plain", '{"bad"', None, "{}"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "line string").select(tables.flatten(F.col("line"), ".")).collect()]
    assert got == ['{"a.b": 2, "d.0": 1, "d.1": [2], "d.2.e": "é"}', "[1]", "plain", '{"bad"', None, "{}"]


def test_json_keeps_types(spark):
    df = spark.createDataFrame([('{"b":1,"a":"x","c":[true,null]}',)], "line string")
    got = df.select(rename(F.col("line"), {"b": "n"}).alias("r"), strip(F.col("line"), fields=["a"]).alias("s")).first()
    assert got.r == '{"n":1,"a":"x","c":[true,null]}' and got.s == '{"b": 1, "c": [true,null]}'


def test_sizes_and_formats():
    assert [parse_size(x) for x in ("512", " 64K ", "10m", "1g", "3b")] == [512, 65_536, 10 << 20, 1 << 30, 3]
    for bad in ("", "k", "1.5m", "x"):
        with pytest.raises(ValueError):
            parse_size(bad)
    assert [n for n, _ in list_formats()] == ["iso8601", "apache", "syslog", "epoch", "epoch_ms"]


def test_sinks(spark, tmp_path):
    files = {"/logs/one.log": [stamp(1), "  more", stamp(5)], "/logs/two.log": [stamp(0), stamp(3)]}
    df = frame(spark, files)
    lines = lambda p: [r[0] for r in spark.read.text(p).orderBy("_metadata.file_path", "_metadata.file_block_start").collect()]
    assert write_merged(df.coalesce(1), str(tmp_path / "m"), tag=True) == 5
    assert sorted(lines(str(tmp_path / "m"))) == sorted([f"two.log: {stamp(0)}", f"one.log: {stamp(1)}", "one.log:   more", f"two.log: {stamp(3)}", f"one.log: {stamp(5)}"])
    ranked = ordered.merge(df, tag=True).orderBy("rank").collect()
    assert [r.line[:3] for r in ranked] == ["two", "one", "one", "two", "one"] and [r["rank"] for r in ranked] == [1, 2, 3, 4, 5]
    assert write_lines(df.withColumn("file_seq", F.lit(0)).filter("file like '%one%'"), str(tmp_path / "n"), numbers=True) == 3
    assert sorted(lines(str(tmp_path / "n"))) == [f"     1: {stamp(1)}", "     2:   more", f"     3: {stamp(5)}"]
    assert write_lines(df, str(tmp_path / "c"), count_only=True) == 5 and lines(str(tmp_path / "c")) == ["5"]
    assert write_lines(df.filter("false"), str(tmp_path / "e"), order=("file", "lineno")) == 0 and lines(str(tmp_path / "e")) == []
    many = spark.range(5000).selectExpr("'f' AS file", "id AS lineno", "concat('l', id) AS line").repartition(7)
    assert write_lines(many, str(tmp_path / "m"), order=("file", "lineno")) == 5000


def test_white_space_at_the_end_of_shown_lines(spark):
    df = spark.createDataFrame([(7, "a \t "), (8, "  ")], "lineno long, line string")
    line, n = F.col("line"), F.col("lineno")
    shown = [report.numbered(line, n), text.render(line, n, "{_lineno}|{_line}|"), F.array_join(report.context(line, n, F.lit(False), True), "")]
    assert [tuple(r) for r in df.orderBy("lineno").select(*shown).collect()] == [("     7: a \t ", "7|a \t |", "7:a"), ("     8:   ", "8|  |", "8:")]
