"""Streams against the batch operators: any cut into micro-batches, restarts, and what timers let go."""

import random

import pytest
from tidemark.operators import ordered
from tidemark.streaming import stateful

SCHEMA = "file string, lineno long, line string"


def feed(spark, tmp_path, batches, operator, final=()):
    """All rows that ``operator`` gives of the batches: the first two micro-batches in one run, each later one after a restart."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for i, rows in enumerate([*batches, *final]):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            if i == 0 and len(batches) > 1:
                continue
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            q = operator(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            assert q.awaitTermination(120) and q.exception() is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    return sorted(map(tuple, spark.read.parquet(out).collect()), key=repr)


def cut(rng, rows, n):
    """The rows in ``n`` batches, each file's in order from batch to batch, mixed within one."""
    marks = sorted(rng.sample(range(1, len(rows)), n - 1))
    out = [rows[a:b] for a, b in zip([0, *marks], [*marks, len(rows)], strict=True)]
    for b in out:
        rng.shuffle(b)
    return out


def log(rng, n=120):
    rows = []
    for i in range(1, n + 1):
        for f in ("a.log", "b.log"):
            stamp = f"2024-01-0{1 + i // 60}T00:{(i // 2) % 60:02d}:{rng.randrange(60):02d} " if rng.random() < 0.7 else ""
            rows.append((f, i, f"{stamp}job {rng.randrange(3)} {rng.choice(['done', 'done', 'failed'])}" if rng.random() < 0.9 else "same"))
    return rows


def test_annotate(spark, tmp_path):
    rng = random.Random(1)
    rows = log(rng)
    got = feed(spark, tmp_path, cut(rng, rows, 3), lambda s: stateful.annotate(s, "lineno"))
    want = ordered.annotate(spark.createDataFrame(rows, SCHEMA), block=50)
    assert got == sorted(map(tuple, want.select("file", "lineno", "line", "elapsed_ms", "delta_ms").collect()), key=repr)


def test_dedupe_adjacent(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f, i, rng.choice("xxy")) for i in range(1, 100) for f in ("a", "b")] + [("a", 100, ""), ("a", 101, "")]
    got = feed(spark, tmp_path, cut(rng, rows, 3), lambda s: stateful.dedupe_adjacent(s, "lineno"))
    assert got == sorted(map(tuple, ordered.dedupe_adjacent(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


@pytest.mark.parametrize(("size", "kinds"), [(1, 3), (8, 20), (1024, 1500)])
def test_dedupe_cached(spark, tmp_path, size, kinds):
    rng = random.Random(size)
    rows = [(f, i, f"l{rng.randrange(kinds)}") for i in range(1, 1200) for f in ("a", "b")]
    got = feed(spark, tmp_path, cut(rng, rows, 3), lambda s: stateful.dedupe_cached(s, size, "lineno"))
    assert got == sorted(map(tuple, ordered.dedupe_cached(spark.createDataFrame(rows, SCHEMA), size).collect()), key=repr)


def test_chunks(spark, tmp_path):
    rng = random.Random(4)
    rows = log(rng)
    got = feed(spark, tmp_path, cut(rng, rows, 3), lambda s: stateful.chunk_seconds(s, 90, "lineno"))
    assert got == sorted(map(tuple, ordered.chunk_seconds(spark.createDataFrame(rows, SCHEMA), 90).select("file", "lineno", "line", "chunk").collect()), key=repr)


@pytest.mark.parametrize("least", [2, 4])
def test_squash(spark, tmp_path, least):
    rng = random.Random(least)
    rows = [(f, i, f"2024-01-01T00:{i // 60:02d}:{i % 60:02d} {rng.choice(['get 1', 'get 22', 'put 3'])}") for i in range(1, 150) for f in ("a", "b")]
    # a third file whose late lines move the watermark past the last runs of the others
    ahead = [("z", 1, "2024-01-02T00:00:00 end"), ("z", 2, "2024-01-03T00:00:00 stop")]
    got = feed(spark, tmp_path, cut(rng, rows, 3), lambda s: stateful.squash(s, least, 60, "0 seconds", "lineno"), final=[ahead[:1], ahead[1:]])
    want = ordered.squash(spark.createDataFrame(rows + ahead[:1], SCHEMA), least).select("file", "lineno", "line", "repeated")
    assert [r for r in got if r[:2] != ("z", 2)] == sorted(map(tuple, want.collect()), key=repr)


def test_compact_json(spark, tmp_path):
    rng = random.Random(6)
    rows, n = [], {"a": 0, "b": 0}

    def add(f, line):
        n[f] += 1
        rows.append((f, n[f], line))

    for i in range(40):
        f = rng.choice("ab")
        for line in rng.choice([["plain"], ["{", f'  "k": {i},', '  "l": [', "1, 2]", "}"], ['{"one": [1]}'], ["[", "not json", "]"], ["", "} stray"]]):
            add(f, line)
    got = feed(spark, tmp_path, cut(rng, rows, 4), lambda s: stateful.compact_json(s, 300, place="lineno"))
    assert got == sorted(map(tuple, ordered.compact_json(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def test_unclosed_json_goes_after_the_wait(spark, tmp_path):
    rows = [("a", 1, "{"), ("a", 2, '"k": 1'), ("b", 1, "{"), ("b", 2, "}"), ("c", 1, "2024-01-01T00:00:00 x")]
    later = [("b", 3, "{}"), ("c", 2, "2024-01-01T00:10:00 y")]
    last = [("a", 3, "}"), ("a", 4, "[]")]
    got = feed(spark, tmp_path, [rows, later, last], lambda s: stateful.compact_json(s, 300, place="lineno"))
    plain = [("c", 1, "2024-01-01T00:00:00 x"), ("c", 2, "2024-01-01T00:10:00 y")]
    assert got == sorted([("a", 1, "{"), ("a", 2, '"k": 1'), ("a", 3, "}"), ("a", 4, "[]"), ("b", 1, "{}"), ("b", 3, "{}"), *plain], key=repr)


def test_json_beyond_the_limit_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="more than 10 characters"):
        feed(spark, tmp_path, [[("a", 1, "{"), ("a", 2, '"k": "a long value",')]], lambda s: stateful.compact_json(s, 300, most_chars=10, place="lineno"))


def test_a_batch_is_stepped_in_parts():
    """A file's lines of a batch come in order and in bounded parts, and what a batch keeps begins anew with the next one."""
    import pandas as pd

    class Parts(stateful._Lines):
        columns = ("place", "line", "us", "earlier")
        part_rows = 4

        def init(self, handle):
            pass

        def step(self, lines, timers):
            sizes.append(len(lines))
            earlier, self.latest = self.latest, int(lines["place"].iloc[-1])
            return [(int(p), s, None if pd.isna(u) else int(u), earlier) for p, s, u in zip(lines["place"], lines["line"], lines["us"], strict=True)]

    sizes, of = [], Parts()
    frames = [pd.DataFrame({"place": [5, 3, 1], "line": ["e", None, "a"], "us": [5.0, None, 1.0]}), pd.DataFrame({"place": [4, 2, 6], "line": ["d", "b", "f"], "us": [4, 2, 6]})]
    for _ in range(2):
        got = pd.concat(of.handleInputRows(("x",), iter(frames), None))
        assert list(got["place"]) == [1, 2, 3, 4, 5, 6] and "".join(got["line"]) == "abdef" and list(got["us"]) == [1, 2, None, 4, 5, 6]
        assert list(got["earlier"]) == [None] * 4 + [4] * 2
    assert sizes == [4, 2, 4, 2] and not list(of.handleInputRows(("x",), iter([]), None))
