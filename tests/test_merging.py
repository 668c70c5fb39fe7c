"""The live merge against the batch one: any cut, restarts, silent files, files still to come."""

import random
import time

import pytest
from tidemark.operators import ordered
from tidemark.streaming import follow, merging

SCHEMA = "file string, lineno long, line string"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def log(rng, files, n):
    """Lines with times that mostly grow, some out of order, some equal over files, some without."""
    rows, at = [], dict.fromkeys(files, 0)
    for i in range(1, n + 1):
        for f in files:
            at[f] += rng.choice([0, 1, 1, 5, -3])
            s = max(at[f], 0)
            timed = rng.random() < 0.75 and not (f == files[-1] and i < 5)
            rows.append((f, i, f"2024-01-01T00:{s // 60 % 60:02d}:{s % 60:02d} {f} {i}" if timed else f"more {i}"))
    return rows


def run(spark, tmp_path, rows, **options):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = merging.merge(stream, str(tmp_path / "m"), place="lineno", trigger={"availableNow": True}, **options)
    assert q.awaitTermination(120) and q.exception() is None


def shown(df, by="rank"):
    return [tuple(r) for r in df.orderBy(by).select("rank", "file", "lineno", "line", "ets").collect()]


def test_equals_the_batch_merge(spark, tmp_path):
    rng = random.Random(1)
    rows = log(rng, ["/x/a.log", "/x/b.log", "c"], 40)
    rng.shuffle(marks := list(range(1, len(rows))))
    marks = sorted(marks[:3])
    want = shown(ordered.merge(spark.createDataFrame(rows, SCHEMA), block=7))
    for a, b in zip([0, *marks], [*marks, len(rows)], strict=True):
        run(spark, tmp_path, rows[a:b], files=["c"])
        got = shown(merging.merged(spark, str(tmp_path / "m")))
        assert got == want[: len(got)]  # what is out is never taken back
    assert 0 < len(got) < len(rows)
    for _ in range(2):
        merging.finish(spark, str(tmp_path / "m"))
        assert shown(merging.merged(spark, str(tmp_path / "m"))) == want
    timed = ordered.merge(spark.createDataFrame(rows, SCHEMA), skip_untimed=True, tag=True, block=7)
    assert shown(merging.merged(spark, str(tmp_path / "m"), skip_untimed=True, tag=True)) == shown(timed)


def test_files_still_to_come_hold_all(spark, tmp_path):
    rows = [("a", 1, "2024-01-01T00:00:05 x"), ("a", 2, "2024-01-01T00:00:09 y")]
    run(spark, tmp_path, rows, files=["a", "b"])
    assert merging.merged(spark, str(tmp_path / "m")).count() == 0
    run(spark, tmp_path, [("b", 1, "2024-01-01T00:00:07 z")], files=["a", "b"])
    assert [r[1:3] for r in shown(merging.merged(spark, str(tmp_path / "m")))] == [("a", 1), ("b", 1)]


def test_batch_run_again_replaces_its_output(spark, tmp_path):
    rng = random.Random(5)
    rows = log(rng, ["a", "b"], 20)
    run(spark, tmp_path, rows[:20])
    run(spark, tmp_path, rows[20:])
    merging.finish(spark, str(tmp_path / "m"))
    for kind in ("commits", "offsets"):
        assert (tmp_path / "m" / "checkpoint" / kind / "1").exists()
    (tmp_path / "m" / "checkpoint" / "commits" / "1").unlink()  # as if the driver had been lost before it committed
    (tmp_path / "m" / "checkpoint" / "commits" / ".1.crc").unlink(missing_ok=True)
    run(spark, tmp_path, [("b", 21, "2024-01-01T02:00:00 last")])
    merging.finish(spark, str(tmp_path / "m"))
    want = ordered.merge(spark.createDataFrame([*rows, ("b", 21, "2024-01-01T02:00:00 last")], SCHEMA))
    assert shown(merging.merged(spark, str(tmp_path / "m"))) == shown(want)


def test_silent_file_on_followed_logs(spark, tmp_path):
    a, b = tmp_path / "a.log", tmp_path / "b.log"
    stamp = "2024-01-01T00:00:{:02d} {}\n".format
    a.write_text(stamp(1, "a") + stamp(4, "a") + stamp(8, "a"))
    b.write_text(stamp(2, "b"))
    both = follow.follow(spark, str(a), from_start=True).unionByName(follow.follow(spark, str(b), from_start=True))
    q = merging.merge(both, str(tmp_path / "m"), [str(a), str(b)], idle_seconds=6, trigger={"processingTime": "500 milliseconds"})

    def until(n):
        end = time.monotonic() + 60
        while time.monotonic() < end and q.isActive:
            rows = merging.merged(spark, str(tmp_path / "m"), tag=True).orderBy("rank").collect()
            if len(rows) >= n:
                return [r.line[:5] + r.line[-4:] for r in rows]
            time.sleep(0.5)
        raise AssertionError(q.exception() or "nothing came out")

    try:
        assert [s[0] for s in until(2)[:2]] == ["a", "b"]
        assert [s[0] for s in until(4)] == ["a", "b", "a", "a"]  # all are silent: the rest comes out without a new line
        with b.open("a") as f:
            f.write(stamp(3, "late") + stamp(9, "b"))
        assert [s[0] for s in until(6)[4:]] == ["b", "b"]  # late ones come next, in order
    finally:
        q.stop()


def test_empty(spark, tmp_path):
    assert merging.merged(spark, str(tmp_path / "m")).count() == 0
    merging.finish(spark, str(tmp_path / "m"))
    with pytest.raises(ValueError):
        merging.merge(spark.createDataFrame([], SCHEMA), str(tmp_path / "m"), idle_seconds=-1)
