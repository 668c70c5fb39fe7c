"""Operators that look at neighbouring lines, on streams of lines.

Each takes a stream (file, ``place``, line), ``place`` being the column that orders a file's lines (``offset`` as ``follow`` gives
it, or a line number), and keeps what a file's next lines need in Spark's state store, so that its rows are those of the batch
operator of the same name for any cut into micro-batches, also after a restart. Files are keys: each is one task's work in a batch, as
its lines are one sequence, and of a batch its lines are held in memory. Lines of a file must come in order from batch to
batch; within one they may be mixed. Null lines are empty ones.

Where something is held back (an open run, an unclosed group), a timer lets it go. transformWithState needs the RocksDB state store,
which is set for the session where another one is.
"""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import timestamps
from tidemark.operators.carried import micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Lines(StatefulProcessor):
    """Gathers a file's lines of a batch in order and hands them to ``step`` in parts of ``part_rows``; ``columns`` are those of its rows after the file.

    What waits is held as Arrow arrays, little more than the bytes of the lines; only a part at a time is Python objects.
    """

    columns: tuple[str, ...] = ()
    timed = False
    part_rows = 20_000
    latest: int | None = None  # what ``step`` keeps of a batch from part to part

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        places, times, texts, self.latest = [], [], [], None
        for f in rows:
            places.append(f["place"].to_numpy(np.int64))
            times.append(pa.array(f["us"], pa.int64(), from_pandas=True))
            texts.append(pa.array(f["line"], pa.large_string(), from_pandas=True))
        if not places:
            return
        place, us, line = np.concatenate(places), pa.concat_arrays(times), pa.concat_arrays(texts)
        del places, times, texts
        order = np.argsort(place, kind="stable")
        for at in range(0, len(order), self.part_rows):
            part = order[at : at + self.part_rows]
            taken = pa.array(part)
            lines = pd.DataFrame({"place": place[part], "line": line.take(taken).fill_null("").to_numpy(zero_copy_only=False), "us": us.take(taken).to_pandas()})
            yield self._rows(key, self.step(lines, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._rows(key, self.expire(timerValues, expiredTimerInfo.getExpiryTimeInMs()))

    def step(self, lines: pd.DataFrame, timers) -> list[tuple]:
        raise NotImplementedError

    def expire(self, timers, at: int) -> list[tuple]:
        return []

    def close(self) -> None:
        pass

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=list(self.columns), dtype=object)
        out.insert(0, "file", key[0])
        return out


def _run(lines: DataFrame, place: str, processor: _Lines, schema: str, time: str = "none", late: str | None = None) -> DataFrame:
    conf = lines.sparkSession.conf
    if "RocksDB" not in conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = lines.select(F.coalesce("file", F.lit("")).alias("file"), F.col(place).cast("long").alias("place"), "line")
    ts = timestamps.extract(F.col("line"))
    if late is not None:
        # the watermark follows the lines' times; the column used is another, so that no late line is dropped
        rows = rows.withColumn("at", ts.cast("timestamp")).withWatermark("at", late)
        rows = rows.select("file", "place", "line", F.unix_micros("at").alias("us"))
    else:
        rows = rows.withColumn("us", micros(ts))
    out = rows.groupBy("file").transformWithStateInPandas(processor, f"file string, place long, {schema}", "append", time)
    return out.withColumnRenamed("place", place)


# -- times and adjacent duplicates ----------------------------------------------------------------------------------------


class _Annotate(_Lines):
    columns = ("place", "line", "elapsed_ms", "delta_ms")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("times", "first long, last long")

    def step(self, lines, timers):
        first, last = self.state.get() if self.state.exists() else (None, None)
        out = []
        for place, line, us in zip(lines["place"], lines["line"], lines["us"], strict=True):
            if pd.isna(us):
                out.append((place, line, None, None))
                continue
            us = int(us)
            first = us if first is None else first
            out.append((place, line, (us - first) / 1000.0, None if last is None else (us - last) / 1000.0))
            last = us
        if first is not None:
            self.state.update((first, last))
        return out


def annotate(lines: DataFrame, place: str = "offset") -> DataFrame:
    """Rows (file, place, line, elapsed_ms, delta_ms), see ``ordered.annotate``: milliseconds since the file's first and last time."""
    return _run(lines, place, _Annotate(), "line string, elapsed_ms double, delta_ms double")


class _Adjacent(_Lines):
    columns = ("place", "line")

    def init(self, handle):
        self.state = handle.getValueState("last", "line string")

    def step(self, lines, timers):
        last, out = (self.state.get()[0] if self.state.exists() else None), []
        for place, line in zip(lines["place"], lines["line"], strict=True):
            if line != last:
                out.append((place, line))
            last = line
        self.state.update((last,))
        return out


def dedupe_adjacent(lines: DataFrame, place: str = "offset") -> DataFrame:
    """Rows (file, place, line) of lines that differ from the one before them, see ``ordered.dedupe_adjacent``."""
    return _run(lines, place, _Adjacent(), "line string")


# -- duplicates within a bounded memory -----------------------------------------------------------------------------------


class _Cached(_Lines):
    columns = ("place", "line")

    def __init__(self, size: int):
        self.size = size

    def init(self, handle):
        self.state = handle.getListState("admitted", "line string")

    def step(self, lines, timers):
        seen = OrderedDict.fromkeys(r[0] for r in self.state.get())
        out = []
        for place, line in zip(lines["place"], lines["line"], strict=True):
            if line not in seen:
                if len(seen) >= self.size and seen:
                    seen.popitem(last=False)
                seen[line] = None
                out.append((place, line))
        if out:
            self.state.put([(line,) for line in seen])
        return out


def dedupe_cached(lines: DataFrame, size: int = 1024, place: str = "offset") -> DataFrame:
    """Rows (file, place, line) of lines that are not among the last ``size`` admitted, see ``ordered.dedupe_cached``.

    State is the admitted lines in their order, ``size`` a file at most; it is read once and written once a batch and file.
    """
    if size < 1:
        raise ValueError("size must be positive")
    return _run(lines, place, _Cached(size), "line string")


# -- runs and chunks ------------------------------------------------------------------------------------------------------

_NUMBER = re.compile(r"\b\d+\b")


class _Squash(_Lines):
    columns = ("place", "line", "repeated")

    def __init__(self, min_repeat: int, wait_ms: int):
        self.least, self.wait = min_repeat, wait_ms

    def init(self, handle):
        self.run = handle.getValueState("run", "signature string, place long, line string, n long, timer long")
        self.held = handle.getListState("held", "place long, line string")  # of a run that is still shorter than min_repeat
        self.handle = handle

    def _close(self, run, held) -> list[tuple]:
        _, place, line, n = run
        return [(place, f"{line}  [repeated {n}x]", n)] if n >= self.least else [(p, s, 1) for p, s in held]

    def step(self, lines, timers):
        state = self.run.get() if self.run.exists() else None
        run, timer = (list(state[:4]), state[4]) if state else (None, None)
        held = [tuple(r) for r in self.held.get()] if run and run[3] < self.least else []
        out, latest = [], self.latest
        for place, line, us in zip(lines["place"], lines["line"], lines["us"], strict=True):
            signature = _NUMBER.sub("#", line)
            if run is None or signature != run[0]:
                if run is not None:
                    out += self._close(run, held)
                run, held, latest = [signature, int(place), line, 0], [], None
            run[3] += 1
            if run[3] < self.least:
                held.append((int(place), line))
            if not pd.isna(us):
                latest = int(us) // 1000
        self.latest = latest
        if timer is not None:
            self.handle.deleteTimer(timer)
        # at the watermark of the run's last time and the wait, or of now and the wait where no line of this batch has one
        timer = (timers.getCurrentWatermarkInMs() if latest is None else max(latest, timers.getCurrentWatermarkInMs())) + self.wait + 1
        self.handle.registerTimer(timer)
        self.run.update((*run, timer))
        if held:
            self.held.put(held)
        elif self.held.exists():
            self.held.clear()
        return out

    def expire(self, timers, at):
        if not self.run.exists():
            return []
        *run, timer = self.run.get()
        if timer != at:
            return []
        held = [tuple(r) for r in self.held.get()] if run[3] < self.least else []
        self.run.clear()
        if self.held.exists():
            self.held.clear()
        return self._close(run, held)


def squash(lines: DataFrame, min_repeat: int = 2, wait_seconds: float = 60, late: str = "0 seconds", place: str = "offset") -> DataFrame:
    """Rows (file, place, line, repeated), see ``ordered.squash``: runs of lines that are equal but for numbers.

    A file's last run is open until another line ends it, or until the watermark, ``late`` behind the latest time of any
    line, is ``wait_seconds`` past the run's own last time; lines that go on with it later begin a run of their own. State is one
    line a file and, ahead of ``min_repeat``, that many. No line is dropped for being late.
    """
    if min_repeat < 1:
        raise ValueError("min_repeat must be positive")
    return _run(lines, place, _Squash(min_repeat, round(wait_seconds * 1000)), "line string, repeated long", "eventTime", late)


class _Chunks(_Lines):
    columns = ("place", "line", "chunk")

    def __init__(self, span: int):
        self.span = span

    def init(self, handle):
        self.state = handle.getValueState("chunk", "start long, chunk long")

    def step(self, lines, timers):
        start, chunk = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for place, line, us in zip(lines["place"], lines["line"], lines["us"], strict=True):
            if not pd.isna(us):
                if start is None:
                    start = int(us)
                elif us - start >= self.span:
                    start, chunk = int(us), chunk + 1
            out.append((place, line, chunk))
        self.state.update((start, chunk))
        return out


def chunk_seconds(lines: DataFrame, seconds: float, place: str = "offset") -> DataFrame:
    """Rows (file, place, line, chunk), see ``ordered.chunk_seconds``; each line's chunk is known when it comes."""
    if seconds <= 0:
        raise ValueError("seconds must be positive")
    return _run(lines, place, _Chunks(round(seconds * 1_000_000)), "line string, chunk long")


# -- JSON over several lines ----------------------------------------------------------------------------------------------


class _Json(_Lines):
    columns = ("place", "line")

    def __init__(self, wait_ms: int, most_bytes: int):
        self.wait, self.most = wait_ms, most_bytes

    def init(self, handle):
        self.open = handle.getValueState("open", "depth long, bytes long, timer long")
        self.held = handle.getListState("held", "place long, line string")
        self.handle = handle

    @staticmethod
    def _joined(held) -> list[tuple]:
        try:
            text = json.dumps(json.loads("".join(s for _, s in held).strip()), separators=(",", ":"))
        except (ValueError, RecursionError):
            return held
        return [(held[0][0], text)]

    def step(self, lines, timers):
        depth, size, timer = self.open.get() if self.open.exists() else (0, 0, None)
        was_open, fresh, out, latest = depth > 0, [], [], self.latest or 0
        for place, line, us in zip(lines["place"], lines["line"], lines["us"], strict=True):
            latest = latest if pd.isna(us) else max(latest, int(us) // 1000)
            change = line.count("{") + line.count("[") - line.count("}") - line.count("]")
            if depth <= 0 and line.lstrip()[:1] not in ("{", "["):
                out.append((int(place), line))
                continue
            depth, size = max(depth, 0) + change, size + len(line)
            fresh.append((int(place), line))
            if depth <= 0:
                before = [tuple(r) for r in self.held.get()] if was_open else []
                out += self._joined(before + fresh)
                fresh, size, was_open = [], 0, False
                self.held.clear()
            elif size > self.most:
                raise ValueError(f"a group of JSON lines has more than {self.most} characters; raise most_chars, or shorten the wait")
        self.latest = latest
        if timer is not None:
            self.handle.deleteTimer(timer)
        if depth > 0:
            timer = max(latest, timers.getCurrentWatermarkInMs()) + self.wait + 1
            self.handle.registerTimer(timer)
            self.held.appendList(fresh)
            self.open.update((depth, size, timer))
        else:
            self.open.clear()
        return out

    def expire(self, timers, at):
        if not self.open.exists() or self.open.get()[2] != at:
            return []
        held = [tuple(r) for r in self.held.get()]
        self.open.clear()
        self.held.clear()
        return held


def compact_json(lines: DataFrame, wait_seconds: float = 300, late: str = "0 seconds", most_chars: int = 256 << 20, place: str = "offset") -> DataFrame:
    """Rows (file, place, line), see ``ordered.compact_json``: JSON over several lines as one compact line at its first line's place.

    An open group's lines wait in state, those of a batch added to them. An unclosed group goes as it is when the watermark,
    ``late`` behind the latest time of any line, is ``wait_seconds`` past that at its last batch; so it delays itself alone, and what
    comes after is read anew. The watermark follows the lines' times: where no line has one, groups wait until they close. A
    group of more than ``most_chars`` ends the stream with an error rather than with another result.
    """
    return _run(lines, place, _Json(round(wait_seconds * 1000), most_chars), "line string", "eventTime", late)
