"""Byte ranges, the index of splits, the last lines, and the sink that deals lines out."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rows
from tidemark.sources import fanout, logs, ranges


@pytest.fixture
def log(tmp_path):
    rng, lines = random.Random(1), []
    for i in range(1, 2001):
        hour = (i // 100 + (12 if 700 <= i < 800 else 0)) % 24  # one stretch out of order
        stamp = f"2024-01-01T{hour:02d}:{i % 60:02d}:00 " if rng.random() < 0.9 else ""
        lines.append(f"{stamp}line {i} " + "x" * rng.randrange(40))
    path = tmp_path / "big.log"
    path.write_text("\n".join(lines) + "\n")
    return path, lines


def numbers(df):
    return sorted((r.lineno, r.line) for r in df.select("lineno", "line").collect())


def test_index(spark, tmp_path, log):
    path, lines = log
    ranges.build_index(spark, str(path), split_bytes=4096).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    n = index.count()
    assert n > 10 and index.agg(F.sum("lines")).first()[0] == len(lines)
    whole = spark.createDataFrame([(str(path), i, x) for i, x in enumerate(lines, 1)], "file string, lineno long, line string")
    for first, last in ((1, 1), (501, 777), (1990, None), (None, 30), (3000, None)):
        assert numbers(ranges.read_indexed(index, first, last)) == numbers(rows.clip(whole, first or 1, last))
    assert ranges.splits(index, 501, 777).count() < n / 3 and ranges.splits(index, 3000).count() == 0
    start, end = datetime(2024, 1, 1, 3), datetime(2024, 1, 1, 4, 30)
    for keep in (False, True):
        assert numbers(ranges.read_indexed(index, start=start, end=end, keep_untimed=keep)) == numbers(rows.time_range(whole, start, end, keep))
    assert ranges.splits(index, start=start, end=end).count() < n / 3
    late = datetime(2024, 1, 1, 19)  # also where the stretch out of order is
    got = numbers(ranges.read_indexed(index, start=late))
    assert got == numbers(rows.time_range(whole, late)) and any(700 <= i < 800 for i, _ in got)


@pytest.mark.parametrize("text", ["", "a", "a\n", "\n", "\n\n", "a\nb", "a\nb\n", "a\n\nb\n\n", "one\n" * 50 + "part"])
@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_tail_start(tmp_path, text, block):
    path = tmp_path / "t.log"
    path.write_text(text)
    for n in (0, 1, 2, 3, 60):
        begin, whole, _ = ranges.tail_start(str(path), n, block)
        kept = text.splitlines(keepends=True)
        assert text[begin:] == "".join(kept[len(kept) - n :] if 0 < n <= len(kept) else kept if n else [])
        assert n == 0 or whole == text.rfind("\n") + 1


def test_tail_reads_no_more_for_a_larger_file(spark, tmp_path):
    read = []
    for n in (1_000, 100_000):
        path = tmp_path / f"{n}.log"
        path.write_text("".join(f"line {i:08d}\n" for i in range(n)))
        read.append(ranges.tail_start(str(path), 20, 1024)[2])
        assert [r.line for r in ranges.tail(spark, str(path), 20, range_bytes=100).orderBy("offset").collect()] == [f"line {i:08d}" for i in range(n - 20, n)]
    assert read[0] == read[1] == 1024


def test_tail_then_follow(spark, tmp_path):
    path = tmp_path / "live.log"
    path.write_text("".join(f"old {i}\n" for i in range(30)) + "half")
    last, more = ranges.tail_then_follow(spark, str(path), 5)
    with path.open("a") as f:
        f.write(" done\nnew\n")
    assert [r.line for r in last.orderBy("offset").collect()] == [f"old {i}" for i in range(26, 30)]
    query = more.writeStream.format("memory").queryName("tail_more").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        assert [r.line for r in spark.table("tail_more").orderBy("offset").collect()] == ["half done", "new"]
    finally:
        query.stop()


def test_fan_out(spark, tmp_path):
    lines = [f"level={'ab'[i % 2]} n={i}" if i % 5 else "none" for i in range(1, 3001)]
    df = spark.createDataFrame([("f", 0, i, x) for i, x in enumerate(lines, 1)], "file string, file_seq int, lineno long, line string").repartition(7)
    out = tmp_path / "out"
    counts = fanout.fan_out(df, str(out), field="level", prefix="part", suffix=".txt")
    want = {k: [x for x in lines if (x.split()[0][6:] if "=" in x else "unknown") == k] for k in ("a", "b", "unknown")}
    assert counts == {k: len(v) for k, v in want.items()}

    def series(k):
        at, got = 0, []
        while (p := out / f"part_{k}{'' if not at else f'.{at}'}.txt").exists():
            got += p.read_text().splitlines()
            at += 1
        return got

    assert {k: series(k) for k in want} == want
    assert fanout.fan_out(df.limit(0), str(out), field="level", prefix="part", suffix=".txt") == {}
    again = fanout.fan_out(df.filter("lineno <= 10"), str(out), field="level", prefix="part", suffix=".txt")
    assert sum(again.values()) == 10 and series("a") == want["a"] + [x for x in lines[:10] if "=a" in x]
    assert not [p for p in out.iterdir() if p.name.startswith("_")]


def test_fan_out_takes_what_the_commit_names(tmp_path):
    import pyarrow as pa

    writer = fanout._Writer({"path": str(tmp_path), "job": "j"})
    batch = pa.RecordBatch.from_pydict({"bucket": ["a", "a", "b"], "seq": [0, 0, 0], "lineno": [1, 2, 3], "line": ["x", None, "y"]})
    writer.write(iter([batch]))  # an attempt that was lost
    writer.commit([writer.write(iter([batch])), None, writer.write(iter([]))])
    assert (tmp_path / "split_a.log").read_text() == "x\n\n" and (tmp_path / "split_b.log").read_text() == "y\n"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["_counts-j.json", "split_a.log", "split_b.log"]


def test_bucket_key(spark):
    df = spark.createDataFrame([("12 ab",), ("no",), ("7  ",)], "line string")
    key = lambda p: [r[0] for r in df.select(logs.bucket_key(F.col("line"), pattern=p)).collect()]
    assert key(r"(\d+) (?P<n>\w+)") == ["ab", "default", "default"]
    assert key(r"(\d+\s)") == ["12", "default", "7"]
    assert key(r"\d+ ?") == ["12", "default", "7"]


def test_sample_is_the_same_for_any_partitioning(spark):
    df = spark.range(5000).select(F.lit("f").alias("file"), F.col("id").alias("lineno"), F.lit("x").alias("line"))
    one, other = (sorted(r.lineno for r in rows.fraction(d, 0.2, 3).collect()) for d in (df.repartition(3), df.orderBy(F.desc("lineno"))))
    assert one == other and 850 < len(one) < 1150
    assert rows.fraction(df, 0).count() == 0 and rows.fraction(df, 1).count() == 5000


def test_tail_takes_the_last_of_each_file(spark):
    df = spark.createDataFrame([(f, i, "x") for f in "ab" for i in range(1, 9)], "file string, lineno long, line string")
    assert sorted((r.file, r.lineno) for r in rows.tail(df, 2).collect()) == [("a", 7), ("a", 8), ("b", 7), ("b", 8)]
    assert rows.tail(df, 0).count() == 0
