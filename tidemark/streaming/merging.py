"""Several followed files merged by time while they grow."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.streaming.stateful import _Lines, _run

#: Stands for the time of a line that has none, nor any before it.
_UNTIMED = -(1 << 63)
_ROWS = "file string, lineno long, line string, us long, top_us long, top_at long"
#: The place of a line among all: the latest time up to it and the line that brought it, its file, its number.
_KEY = ("top_us", "top_at", "file", "lineno")


class _Places(_Lines):
    columns = ("place", "lineno", "line", "us", "top_us", "top_at")

    def init(self, handle):
        self.state = handle.getValueState("last", "lineno long, us long, top_us long, top_at long")

    def step(self, lines, timers):
        n, last, *top = self.state.get() if self.state.exists() else (0, None, _UNTIMED, 0)
        top, out = tuple(top), []
        for place, line, us in zip(lines["place"], lines["line"], lines["us"], strict=True):
            n += 1
            last = last if pd.isna(us) else int(us)
            top = max(top, (_UNTIMED if last is None else last, n))
            out.append((place, n, line, last, *top))
        self.state.update((n, last, *top))
        return out


class _Store:
    """The folder of a merge: ``rows`` as they came, a folder a batch; ``out``, what has been released; ``state`` after each batch.

    A batch has an even number, twice its own; what ``finish`` released after it has the odd one that follows. All is written anew when a batch is
    run again, from the state of the batch before it, which is kept until the next one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark._jvm

    def path(self, kind: str, n: int) -> str:
        return f"{self.folder}/{kind}/part={n:012d}"

    def _fs(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def delete(self, kind: str, n: int) -> None:
        fs, path = self._fs(self.path(kind, n))
        fs.delete(path, True)

    def exists(self, kind: str, n: int) -> bool:
        fs, path = self._fs(f"{self.path(kind, n)}/_SUCCESS")
        return fs.exists(path)

    def load(self, n: int) -> dict:
        """The state after part ``n``; that of the beginning for a negative number."""
        if n < 0:
            return {"last": {}, "seen": {}, "cut": None, "held": {}, "dropped": []}
        return json.loads(self.spark.read.text(self.path("state", n)).first()[0])

    def save(self, n: int, state: dict) -> None:
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(self.path("state", n))

    def release(self, n: int, state: dict, cut: list | None, late: int | None) -> None:
        """Writes the held lines up to ``cut``, and of folder ``late`` those behind the last one too, in order, as part ``n``; ``state`` goes on."""
        before = state["cut"]
        parts = []
        for folder in map(int, state["held"]):
            rows = self.spark.read.schema(_ROWS).parquet(self.path("rows", folder))
            rows = rows.filter((F.col("top_us") <= cut[0]) & (_key() <= _key(cut)))
            parts.append(rows if before is None or folder == late else rows.filter((F.col("top_us") >= before[0]) & (_key() > _key(before))))
        if parts:
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            # the upper bits of the id are the range of the sort, the lower 33 the place in it
            out.orderBy(*_KEY).withColumn("_at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(self.path("out", n))
        state["cut"] = cut if before is None else max(before, cut)
        state["dropped"] = [f for f, top in state["held"].items() if top <= state["cut"]]
        state["held"] = {f: top for f, top in state["held"].items() if top > state["cut"]}


def _key(of: Sequence | None = None) -> Column:
    return F.struct(*(F.col(c) if of is None else F.lit(v).cast("string" if c == "file" else "long").alias(c) for c, v in zip(_KEY, of or _KEY, strict=True)))


def merge(
    lines: DataFrame,
    folder: str,
    files: Sequence[str] = (),
    *,
    idle_seconds: float | None = None,
    place: str = "offset",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Starts a query that merges the files of a stream of lines (file, ``place``, line) by time, as ``ordered.merge`` does, into ``folder``.

    A line is released when no file can bring one ahead of it any more: when it stands ahead of the last line that each file has
    brought so far (a file's lines never go behind its own latest time). ``files`` names those that are waited for before they have brought any.
    With ``idle_seconds`` a file that has brought nothing for so long, by the clock, no longer holds the others back; lines that it brings
    later, though they belong ahead of what is out, come out next and in order among themselves. Without it nothing comes out of order, and a
    silent file holds all. ``finish`` releases the rest when the query has been stopped; ``merged`` reads what is out.

    The state of a file is four numbers. Held lines lie in ``folder`` as Parquet, each written once, and are dealt over tasks like any table: no
    task and no state holds the lines of several files. What is out is sorted by range. A batch that is run again after a failure
    replaces what it wrote. The driver sees one row a file and one a held batch. ``folder`` must be one that the whole cluster
    shares; it holds the query's checkpoint as well. Null lines are empty ones, and lines without a file are of file ''.
    """
    if idle_seconds is not None and idle_seconds < 0:
        raise ValueError("idle_seconds must not be negative")
    # with timers on the clock Spark runs batches without lines as well, so that silence is noticed when all are silent
    rows = lines.select("file", F.col(place).alias("_at"), "line")
    placed = _run(rows, "_at", _Places(), "lineno long, line string, us long, top_us long, top_at long", "none" if idle_seconds is None else "processingTime")

    def step(batch: DataFrame, number: int) -> None:
        store, n = _Store(batch.sparkSession, folder), 2 * number
        for kind in ("out", "state"):
            store.delete(kind, n)
            store.delete(kind, n + 1)
        base = n - 1 if n and store.exists("state", n - 1) else n - 2
        state, now = store.load(base), time.time()
        for old in state["dropped"]:
            store.delete("rows", int(old))
        for old in (n - 4, n - 3):
            store.delete("state", old)
        batch.select("file", "lineno", "line", "us", "top_us", "top_at").write.mode("overwrite").parquet(store.path("rows", n))
        came = store.spark.read.schema(_ROWS).parquet(store.path("rows", n))
        new = {r.file: list(r.top) for r in came.groupBy("file").agg(F.max(_key()).alias("top")).collect()}
        state["last"] |= new
        state["seen"] |= dict.fromkeys([*new, *(f for f in files if f not in state["seen"])], now)
        if new:
            state["held"][str(n)] = max(new.values())
        else:
            store.delete("rows", n)
        waited = [f for f in {*files, *state["last"]} if idle_seconds is None or now - state["seen"][f] < idle_seconds]
        state["dropped"] = []
        if state["held"] and all(f in state["last"] for f in waited):
            cut = min((state["last"][f] for f in waited), default=max(state["held"].values()))
            if state["cut"] is None or cut > state["cut"] or any(top <= state["cut"] for top in new.values()):
                store.release(n, state, max(cut, state["cut"] or cut), n)
        store.save(n, state)

    started = placed.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint")
    return started.trigger(**(trigger or {"processingTime": "1 second"})).start()


def _parts(spark: SparkSession, folder: str, kind: str) -> list[int]:
    store = _Store(spark, folder)
    fs, path = store._fs(f"{store.folder}/{kind}")
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path)) if fs.exists(path) else []


def finish(spark: SparkSession, folder: str) -> None:
    """Releases all that a stopped query of ``merge`` holds. The query may be started again; further calls then change nothing until it was."""
    store = _Store(spark, folder)
    done = [n for n in _parts(spark, folder, "state") if store.exists("state", n)]
    if not done or done[-1] % 2:
        return
    state = store.load(done[-1])
    if state["held"]:
        dropped = state["dropped"]
        store.release(done[-1] + 1, state, max(state["held"].values()), None)
        state["dropped"] += dropped
        store.save(done[-1] + 1, state)


def merged(spark: SparkSession, folder: str, *, skip_untimed: bool = False, tag: bool = False) -> DataFrame:
    """Rows (file, lineno, line, ets, rank) of what ``merge`` has released so far, ``rank`` being the place among all, from 1.

    ``ets`` is the line's own time or that of the last line before it that has one; ``skip_untimed`` leaves out lines without. With ``tag`` the name of
    the file, without its folders, stands before each line. Ranks do not change as more comes out. Ranges are counted, a row for each, and the counts joined back.
    """
    store = _Store(spark, folder)
    whole = [n for n in _parts(spark, folder, "out") if store.exists("out", n)]
    schema = f"{_ROWS}, _at long"
    if not whole:
        rows = spark.createDataFrame([], f"{schema}, part long")
    else:
        rows = spark.read.schema(f"{schema}, part long").option("basePath", f"{store.folder}/out").parquet(*(store.path("out", n) for n in whole))
    if skip_untimed:
        rows = rows.filter("us is not null")
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    counts = rows.groupBy("part", "_range").count()
    earlier = W.orderBy("part", "_range").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("part", "_range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    if skip_untimed:  # lines without a time are gaps in a range's numbers
        rows = rows.withColumn("_place", F.row_number().over(W.partitionBy("part", "_range").orderBy("_at")))
    else:
        rows = rows.withColumn("_place", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    line = F.concat(F.element_at(F.split("file", "/"), -1), F.lit(": "), "line") if tag else F.col("line")
    ets = F.expr("timestampadd(MICROSECOND, us, timestamp_ntz'1970-01-01')")
    return rows.join(before, ["part", "_range"]).select("file", "lineno", line.alias("line"), ets.alias("ets"), (F.col("_before") + F.col("_place")).alias("rank"))
