"""Following a growing log through its rotations: a streaming source whose offset is a position in a file that can be told again."""

from __future__ import annotations

import gzip
import hashlib
import os
import re
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from tidemark.functions import timestamps


class _Log:
    """A growing file under whatever name rotation has given it.

    An offset tells a file by its inode and by digests of its first bytes and of those ahead of the position, so it is found again
    when renamed, copied and truncated, or compressed, and a file that has been put in its place is not taken for it, however large.
    """

    SAMPLE = 256

    def __init__(self, options: dict):
        self.path, self.from_start = options["path"], options.get("fromStart", "false") == "true"
        self.most = int(options.get("maxBytes", 8 << 20))
        self.start = int(options["start"]) if "start" in options else None

    def names(self) -> list[str]:
        """The rotated files, oldest first, and the live one, as far as they exist."""
        folder, name = os.path.split(self.path)
        found = {}
        for other in os.listdir(folder or ".") if os.path.isdir(folder or ".") else ():
            if m := re.fullmatch(re.escape(name) + r"\.(\d+)(\.gz)?", other):
                if int(m[1]) not in found or not m[2]:  # while it is being compressed, a file is there twice
                    found[int(m[1])] = os.path.join(folder, other)
        return [found[i] for i in sorted(found, reverse=True)] + [self.path] * os.path.exists(self.path)

    @staticmethod
    def open(name: str):
        return gzip.open(name, "rb") if name.endswith(".gz") else open(name, "rb")

    def size(self, name: str) -> int:
        if not name.endswith(".gz"):
            return os.path.getsize(name)
        with self.open(name) as f:
            return f.seek(0, os.SEEK_END)

    def _digests(self, f, at: int) -> tuple[str, str, bool]:
        """Of a file's first bytes and of those ahead of ``at``; whether it has so many."""
        first = f.read(min(at, self.SAMPLE))
        f.seek(max(0, at - self.SAMPLE))
        last = f.read(min(at, self.SAMPLE))
        return hashlib.sha1(first).hexdigest(), hashlib.sha1(last).hexdigest(), len(last) == min(at, self.SAMPLE)

    def mark(self, name: str, at: int, base: int) -> dict:
        """The offset of position ``at`` of a file; ``base`` is how many bytes of the log came ahead of the file."""
        if not os.path.exists(name):
            return {"at": 0, "base": base}
        with self.open(name) as f:
            first, last, _ = self._digests(f, at)
        return {"at": at, "base": base, "inode": os.stat(name).st_ino, "first": first, "last": last}

    def locate(self, mark: dict) -> str | None:
        """The file of an offset; None if it is gone."""
        found = None
        for name in self.names():
            try:
                same = os.stat(name).st_ino == mark.get("inode")
                if mark["at"]:
                    with self.open(name) as f:
                        if "first" in mark and self._digests(f, mark["at"]) != (mark["first"], mark["last"], True):
                            continue
                elif not same:
                    continue
            except OSError:  # renamed meanwhile
                continue
            found = name
            if same:
                return name
        return found

    def segments(self, start: dict, end: dict | None) -> list[tuple[str, int, int | None, int]]:
        """(file, from, to, bytes of the log ahead of the file) from one offset to another, or to the end of the live file.

        ``to`` is None for the end of a file that has been rotated away. If the file of ``start`` is gone, what it still held is lost, and
        reading goes on with the oldest file that is sure to be newer: that of ``end``.
        """
        names = self.names()
        here = self.locate(start)
        last = self.path if end is None else self.locate(end) or self.path
        if last not in names:
            return []
        if here is None:
            return [(last, 0, None if end is None else end["at"], start["base"] + start["at"])]
        at, base, out = start["at"], start["base"], []
        chain = names[names.index(here) : names.index(last) + 1]
        for name in chain:
            final = name == last
            out.append((name, at, end["at"] if final and end is not None else None, base))
            if not final:
                base += self.size(name)
            at = 0
        return out

    def initialOffset(self) -> dict:
        if self.start is not None:
            return self.mark(self.path, self.start, 0)
        if self.from_start or not os.path.exists(self.path):
            return self.mark(self.path, 0, 0)
        return self.mark(self.path, os.path.getsize(self.path), 0)


class _Reader(_Log, SimpleDataSourceStreamReader):
    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """Whole lines from the offset on, ``maxBytes`` of them, from the files that they are in by now; a line still being written
        is held back, the last one of a file that has been rotated away is not."""
        rows, end, left = [], start, self.most
        for name, at, _, base in self.segments(start, None):
            size, live = self.size(name), name == self.path
            got, upto = self._lines(name, at, min(size, at + left), base, size, live)
            rows += got
            left -= upto - at
            end = self.mark(name, upto, base)
            if left <= 0 or (upto < size and not live):
                break
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = []
        for name, at, until, base in self.segments(start, end):
            size = self.size(name)
            if until is None or until > at:
                rows += self._lines(name, at, size if until is None else until, base, size, until is not None and name == self.path)[0]
        return iter(rows)

    def _lines(self, name: str, at: int, until: int, base: int, size: int, live: bool) -> tuple[list[tuple], int]:
        with self.open(name) as f:
            f.seek(at)
            data = f.read(until - at)
            if data and b"\n" not in data:  # a line longer than a batch is read to its end
                parts = [data]
                while (part := f.read(self.most)) and b"\n" not in part:
                    parts.append(part)
                data = b"".join([*parts, part[: part.find(b"\n") + 1]])
        whole = not live and at + len(data) >= size
        end = len(data) if whole else data.rfind(b"\n") + 1
        rows, pos = [], at
        for line in _split(data[:end]):
            rows.append((self.path, base + pos, line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")))
            pos += len(line)
        return rows, at + end


def _split(data: bytes) -> list[bytes]:
    """Lines with their line feeds; the last may lack one."""
    parts = data.split(b"\n")
    return [p + b"\n" for p in parts[:-1]] + [parts[-1]] * bool(parts[-1])


class _SharedReader(_Log, DataSourceStreamReader):
    """The driver keeps offsets only; tasks read ranges of ``maxBytes``, each the lines that begin in its own."""

    def latestOffset(self) -> dict:
        """The end of the last whole line of the live file, looked for from its end; 0 if there is none."""
        if not os.path.exists(self.path):
            return self.mark(self.path, 0, 0)
        with open(self.path, "rb") as f:
            at = f.seek(0, os.SEEK_END)
            while at:
                begin = max(0, at - (1 << 16))
                f.seek(begin)
                if (found := f.read(at - begin).rfind(b"\n")) >= 0:
                    return self.mark(self.path, begin + found + 1, 0)
                at = begin
        return self.mark(self.path, 0, 0)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Ranges of (offset that tells the file, begin, end, first of its file's). A start within a line that is still being written
        lies ahead of the end; nothing is read then."""
        out = []
        for name, at, until, _ in self.segments(start, end):
            until = self.size(name) if until is None else until
            if until > at:
                file = self.mark(name, until, 0)
                out += [InputPartition((file, a, min(a + self.most, until), a == at)) for a in range(at, until, self.most)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        file, at, until, first = partition.value
        name = self.locate(file)
        if name is None:
            raise FileNotFoundError(f"{self.path}: the file of a batch is gone")
        with self.open(name) as f:
            if not first:  # from the byte before, so that a line that begins with the range is its own
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < until and (line := f.readline()):
                yield self.path, at, line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
                at += len(line)


class FollowSource(DataSource):
    """Rows (file, offset, line). Options: path, fromStart (false), maxBytes of a batch (more for a longer line), shared, start.

    ``file`` is the path followed, also for lines that rotation has moved elsewhere. ``offset`` counts the bytes of the log from the file
    on that was live at first, over all rotations, so it orders the lines; with ``shared`` it begins anew in each file.

    With ``shared`` (false) every machine sees the path: a batch is all that is there, read by tasks of ``maxBytes`` each.
    """

    @classmethod
    def name(cls) -> str:
        return "follow"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def streamReader(self, schema) -> _SharedReader:
        if self.options.get("shared", "false") != "true":
            return super().streamReader(schema)  # not implemented: the driver's reader serves
        return _SharedReader(self.options)

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def follow(spark: SparkSession, path: str, from_start: bool = False, shared: bool = False, lines: int | None = None, max_bytes: int = 8 << 20, start: int | None = None) -> DataFrame:
    """The lines appended to a file, as a stream; the first ``lines`` of them, if given. It begins at byte ``start``, at the file's
    beginning if ``from_start``, or else at its end.

    The driver reads the file, as for any tail of its own machine's; one on a folder that all machines share (``shared``)
    is read by tasks, and a line is in one task's range alone. Files renamed to ``path.N`` (``.gz`` too), or copied there and truncated, are read
    to their end before the new one; lines are lost only where a file is deleted, or emptied without a copy, before it is read.
    """
    spark.dataSource.register(FollowSource)
    flags = {"fromStart": str(from_start).lower(), "shared": str(shared).lower(), "maxBytes": max_bytes} | ({} if start is None else {"start": start})
    out = spark.readStream.format("follow").option("path", path).options(**flags).load()
    return out if lines is None else out.limit(lines)


def run_until(query: StreamingQuery, lines: int | None = None, path: str | None = None, poll: float = 0.2, timeout: float | None = None) -> int:
    """Lets a query on a followed file run until ``lines`` have been read, the file ``path`` is gone, or ``timeout`` seconds have
    passed; stops it, and returns how many lines were read. What was there when the file went is read first."""
    began = time.monotonic()
    seen: dict[int, int] = {}
    while query.isActive:
        gone = path is not None and not os.path.exists(path)
        if gone:
            query.processAllAvailable()
        for p in query.recentProgress:
            seen[p.batchId] = max(seen.get(p.batchId, 0), p.numInputRows)
        if gone or lines is not None and sum(seen.values()) >= lines or timeout is not None and time.monotonic() - began >= timeout:
            query.stop()
            break
        time.sleep(poll)
    if query.exception() is not None:
        raise query.exception()
    return sum(seen.values())


def live_rate(lines: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Lines by window of event time; windows close ``late`` after the latest time seen."""
    timed = lines.withColumn("ts", timestamps.extract(F.col("line")).cast("timestamp")).filter("ts is not null").withWatermark("ts", late)
    return timed.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).count().select(F.col("w.start").alias("bucket"), "count")
