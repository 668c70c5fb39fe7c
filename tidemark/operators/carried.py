"""Operators whose state runs through a whole file, in blocks of lines that many tasks share.

What a block does hangs on the state at its first line. Where that is a number, each block sums up what it makes of any number;
one pass over these few rows a file gives every block its state, and the blocks are then done side by side. Where it is more,
blocks start from a guess, and those that it matters to are done again until the states agree.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import timestamps

BLOCK = 65_536


def blocks(df: DataFrame, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor((F.col("lineno") - 1) / block).cast("long"))


def micros(ts):
    """Microseconds of a naive time since 1970, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def _walk(summaries: DataFrame, step: Callable[[dict | None, dict], dict], schema: str) -> DataFrame:
    """The state ahead of each block: ``step(state, summary)`` goes through a file's summaries in order, one at a time."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["file"] != file:
                    file, state = row["file"], None
                out.append((state or {}) | {"file": file, "_block": row["_block"]})
                state = step(state, row)
            cols = [pa.array([o.get(n) for o in out], pa.string() if n == "file" else pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return summaries.repartition("file").sortWithinPartitions("file", "_block").mapInArrow(run, schema)


def _rounds(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes a round's table and reads it again, and deletes that of two rounds ago; the last go with the session.

    A checkpoint would compute the last stage twice, and keep the size that Spark estimates; where a table is joined with itself round by round that estimate squares each time.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    context, written = spark.sparkContext, []
    folder = f"{base}/rounds-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)

    def write(df: DataFrame) -> DataFrame:
        written.append(f"{folder}/{len(written)}")
        df.write.parquet(written[-1])
        if len(written) > 2:
            old = context._jvm.org.apache.hadoop.fs.Path(written[-3])
            old.getFileSystem(context._jsc.hadoopConfiguration()).delete(old, True)
        return spark.read.schema(df.schema).parquet(written[-1])

    return write


def _sorted(group: pa.Table) -> pa.Table:
    return group.take(pa.array(np.argsort(group.column("lineno").to_numpy(), kind="stable")))


# -- chunks by time -------------------------------------------------------------------------------------------------------


def _leaps(us: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[int]]:
    """Of a block's times: the places and values of those that exceed all before; from each, where the next chunk begins, the start of the
    chunk that is open at the end, and the chunks begun on the way. Only such times can begin a chunk, in whatever order lines come."""
    top = np.maximum.accumulate(us)
    at = np.flatnonzero(np.concatenate([[True], us[1:] > top[:-1]]))
    v = us[at]
    following = np.searchsorted(v, v + span, side="left")
    leave, chunks = v.tolist(), [1] * len(v)
    for i in range(len(v) - 1, -1, -1):
        if (j := int(following[i])) < len(v):
            leave[i], chunks[i] = leave[j], 1 + chunks[j]
    return at, v, following, leave, chunks


def chunk_seconds(df: DataFrame, seconds: float, block: int = BLOCK) -> DataFrame:
    """Rows (file, lineno, line, chunk). A chunk ends where a line is ``seconds`` or more after its first timed line; untimed lines
    join the chunk they are in. Chunks count from 0 in each file.

    A block's summary tells for any start of the open chunk which start it leaves, in as many entries as differ: about
    the lines of the last ``seconds`` of the block. One task a file goes through the summaries; lines never leave their blocks.
    """
    if seconds <= 0:
        raise ValueError("seconds must be positive")
    span = round(seconds * 1_000_000)
    rows = blocks(df.select("file", "lineno", "line", micros(timestamps.extract(F.col("line"))).alias("_us")), block)
    summary = "file string, _block long, upto array<long>, leave array<long>, chunks array<long>"
    names = [f.split()[0] for f in summary.split(", ")]
    longs = pa.list_(pa.int64())

    def sum_up(group: pa.Table) -> pa.Table:
        us = _sorted(group).column("_us").drop_null().to_numpy()
        upto, leave, chunks = [], [], []
        if len(us):
            _, v, _, ends, counts = _leaps(us, span)
            last = [i for i in range(len(v)) if i + 1 == len(v) or (ends[i], counts[i]) != (ends[i + 1], counts[i + 1])]
            upto, leave, chunks = [int(v[0]), *(int(v[i]) for i in last)], [ends[0], *(ends[i] for i in last)], [counts[0], *(counts[i] for i in last)]
        cols = [group.column("file")[:1].combine_chunks(), group.column("_block")[:1].combine_chunks(), *(pa.array([x], longs) for x in (upto, leave, chunks))]
        return pa.Table.from_arrays(cols, names=names)

    def step(state: dict | None, row: dict) -> dict:
        state = state or {"_start": None, "_chunk": 0}
        if not row["upto"]:
            return state
        if state["_start"] is None:  # the first entry is that of a chunk that begins with the block's first time
            return {"_start": row["leave"][0], "_chunk": state["_chunk"] + row["chunks"][0] - 1}
        j = bisect_left(row["upto"], state["_start"] + span, 1)
        return state if j == len(row["upto"]) else {"_start": row["leave"][j], "_chunk": state["_chunk"] + row["chunks"][j]}

    def assign(group: pa.Table) -> pa.Table:
        group = _sorted(group)
        us, start, chunk = group.column("_us"), group.column("_start")[0].as_py(), group.column("_chunk")[0].as_py() or 0
        timed = np.flatnonzero(us.is_valid().to_numpy())
        begins = []
        if len(timed):
            at, v, following, _, _ = _leaps(us.drop_null().to_numpy(), span)
            j = int(following[0]) if start is None else int(np.searchsorted(v, start + span, side="left"))
            while j < len(v):
                begins.append(timed[at[j]])
                j = int(following[j])
        out = chunk + np.searchsorted(np.array(begins, np.int64), np.arange(group.num_rows), side="right")
        return pa.Table.from_arrays([*(group.column(c) for c in ("file", "lineno", "line")), pa.array(out, pa.int64())], names=["file", "lineno", "line", "chunk"])

    per = rows.select("file", "_block", "lineno", "_us").groupBy("file", "_block").applyInArrow(sum_up, summary)
    states = _walk(per, step, "file string, _block long, _start long, _chunk long")
    return rows.join(states, ["file", "_block"]).groupBy("file", "_block").applyInArrow(assign, "file string, lineno long, line string, chunk long")


# -- JSON over several lines ----------------------------------------------------------------------------------------------


def _ends_of_openers(change: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, list[int], list[int], list[int]]:
    """Of a block: running sums of the change in depth, for each line the one that ends the group it would open (itself, or the
    number of lines if none does), and for each line the depth and the opener left at the end if no group is open ahead of it."""
    sums = np.cumsum(change)
    n, before = len(change), [0, *sums.tolist()]
    end, stack = [n] * n, []
    for i in range(n, 0, -1):  # the next running sum that is not above the one ahead of the line
        while stack and before[stack[-1]] > before[i - 1]:
            stack.pop()
        if before[i] <= before[i - 1]:
            end[i - 1] = i - 1
        else:
            while stack and before[stack[-1]] > before[i - 1]:
                stack.pop()
            end[i - 1] = stack[-1] - 1 if stack else n
        # a sum stays on the stack until a smaller one comes ahead of it
        while stack and before[stack[-1]] >= before[i]:
            stack.pop()
        stack.append(i)
    depth, opener = [0] * (n + 1), [-1] * (n + 1)
    for i in range(n - 1, -1, -1):
        if not opens[i]:
            depth[i], opener[i] = depth[i + 1], opener[i + 1]
        elif end[i] < n:
            depth[i], opener[i] = depth[end[i] + 1], opener[end[i] + 1]
        else:
            depth[i], opener[i] = before[n] - before[i], i
    return sums, end, depth, opener


def compact_json(df: DataFrame, block: int = BLOCK, most_bytes: int = 1 << 30) -> DataFrame:
    """Rows (file, lineno, line): JSON that runs over several lines as one compact line, at its first line's number; what does
    not parse stays as it was.

    A line that begins with a bracket, outside of a group, opens one, which ends where as many brackets have closed. A block's
    summary tells for any depth ahead of it which depth it leaves; one task a file goes through the summaries. A group that lies in
    one block is joined there; lines of one that crosses an edge meet by its number. A closed group of more than ``most_bytes`` is an error, as a row could not hold it. One bracket that is never
    closed takes all that follows with it: such a group parses only if brackets stand in its strings, so beyond ``most_bytes``
    it stays as it is and is not gathered.
    """
    opens = F.col("line").rlike(r"(?U)^\s*[\{\[]")
    change = (F.regexp_count("line", F.lit(r"[\{\[]")) - F.regexp_count("line", F.lit(r"[\}\]]"))).cast("long")
    rows = blocks(df.select("file", "lineno", "line"), block).withColumn("_change", F.coalesce(change, F.lit(0))).withColumn("_opens", F.coalesce(opens, F.lit(False)))
    summary = "file string, _block long, upto array<long>, leave array<long>, opener array<long>, total long, outside long, outside_opener long"
    names = [f.split()[0] for f in summary.split(", ")]

    def sum_up(group: pa.Table) -> pa.Table:
        group = _sorted(group)
        numbers = group.column("lineno").to_numpy()
        sums, _, depth, opener = _ends_of_openers(group.column("_change").to_numpy(), group.column("_opens").to_numpy())
        line_of = lambda i: None if opener[i] < 0 else int(numbers[opener[i]])
        low = np.minimum.accumulate(np.concatenate([[0], sums]))
        at = np.flatnonzero(low[1:] < low[:-1])  # where a depth is closed that no line before closes
        cols = [group.column("file")[:1].combine_chunks(), group.column("_block")[:1].combine_chunks()]
        cols += [pa.array([x], pa.list_(pa.int64())) for x in ((-sums[at]).tolist(), [depth[i + 1] for i in at], [line_of(i + 1) for i in at])]
        cols += [pa.array([x], pa.int64()) for x in (int(sums[-1]), depth[0], line_of(0))]
        return pa.Table.from_arrays(cols, names=names)

    def step(state: dict | None, row: dict) -> dict:
        state = state or {"_depth": 0, "_opener": None}
        if state["_depth"] <= 0:
            return {"_depth": row["outside"], "_opener": row["outside_opener"]}
        j = bisect_left(row["upto"], state["_depth"])
        if j == len(row["upto"]):
            return {"_depth": state["_depth"] + row["total"], "_opener": state["_opener"]}
        return {"_depth": row["leave"][j], "_opener": row["opener"][j]}

    def compact(lines: list[str | None]) -> str | None:
        try:
            return json.dumps(json.loads("".join(x or "" for x in lines).strip()), separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    def assign(group: pa.Table) -> pa.Table:
        """Lines outside of groups, groups of this block as one line each, and the lines of other groups with the number of the one that opens it."""
        group = _sorted(group)
        numbers, n = group.column("lineno").to_numpy(), group.num_rows
        sums, end, _, _ = _ends_of_openers(group.column("_change").to_numpy(), opened := group.column("_opens").to_numpy())
        out, i, lines, gone = [None] * n, 0, group.column("line").to_pylist(), np.zeros(n, bool)
        depth = group.column("_depth")[0].as_py() or 0
        if depth > 0:
            closed = np.flatnonzero(depth + sums <= 0)
            i = int(closed[0]) + 1 if len(closed) else n
            out[:i] = [group.column("_opener")[0].as_py()] * i
        while i < n:
            if opened[i]:
                stop = min(end[i], n - 1) + 1
                if end[i] < n and sum(len((x or "").encode("utf-8", "surrogatepass")) for x in lines[i:stop]) <= most_bytes:
                    if (text := compact(lines[i:stop])) is not None:
                        lines[i] = text
                        gone[i + 1 : stop] = True
                else:
                    out[i:stop] = [int(numbers[i])] * (stop - i)
                i = stop
            else:
                i += 1
        made = pa.Table.from_arrays([*(group.column(c) for c in ("file", "lineno")), pa.array(lines, pa.string()), pa.array(out, pa.int64())], names=["file", "lineno", "line", "_group"])
        return made.filter(pa.array(~gone)) if gone.any() else made

    def join(group: pa.Table) -> pa.Table:
        group = _sorted(group)
        if (text := compact(group.column("line").to_pylist())) is None:
            return group.select(["file", "lineno", "line"])
        first = group.slice(0, 1)
        return pa.Table.from_arrays([first.column("file"), first.column("lineno"), pa.array([text], pa.string())], names=["file", "lineno", "line"])

    per = rows.select("file", "_block", "lineno", "_change", "_opens").groupBy("file", "_block").applyInArrow(sum_up, summary)
    states = _walk(per, step, "file string, _block long, _depth long, _opener long")
    told = _rounds(df.sparkSession)(rows.join(states, ["file", "_block"]).groupBy("file", "_block").applyInArrow(assign, "file string, lineno long, line string, _group long"))
    held = told.filter("_group is not null")
    big = held.groupBy("file", "_group").agg(F.sum(F.octet_length("line")).alias("_bytes"), (F.sum(change) > 0).alias("_open")).filter(F.col("_bytes") > most_bytes)
    said = F.concat(F.lit("a group of JSON lines has more bytes than most_bytes; it begins at line "), F.col("_group").cast("string"), F.lit(" of "), "file")
    big = big.filter(F.when(F.col("_open"), F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))).select("file", "_group")
    shape = "file string, lineno long, line string"
    joined = held.join(big, ["file", "_group"], "left_anti").groupBy("file", "_group").applyInArrow(join, shape)
    stay = held.join(big, ["file", "_group"], "left_semi")
    return told.filter("_group is null").select("file", "lineno", "line").unionByName(joined).unionByName(stay.select("file", "lineno", "line"))


# -- duplicates within a bounded memory -----------------------------------------------------------------------------------


def dedupe_cached(df: DataFrame, size: int = 1024, block: int = BLOCK) -> DataFrame:
    """Rows (file, lineno, line): lines that are not among the last ``size`` admitted ones; being met again does not make a line younger.

    Files of one block are done at once. For others, lines' digests are written, about 40 bytes a line, and each block is run from
    an empty memory. Then, round by round, tasks walk through stretches of blocks. A block that admits nothing, or whose new lines
    drive none out, turns any memory into the next by its distinct lines alone; one that was run from the memory it now starts with is known
    too. Only the others are run again, side by side, from what they now start with, until none is left and stretches agree at their edges.

    So a file with few different lines takes a round for each stretch, and where new lines are many, blocks forget their start and
    agree after two or three. In between, where lines are driven out slowly all the way, there may be as many rounds as blocks.
    A stretch is up to 256 blocks, fewer for large memories, so that a task holds about 1.5 million digests at most.
    A null line is a line like others. Needs a checkpoint directory.
    """
    most = max(1, size)
    stretch = max(2, min(256, (1 << 19) // most))
    rows = blocks(df.select("file", "lineno", "line"), block).withColumn("_key", F.unhex(F.sha2("line", 256)))
    digests, at = pa.list_(pa.binary()), ["file", "_block"]

    def admit(keys: list[bytes | None], start: list[bytes | None]) -> tuple[list[int], list[bytes | None]]:
        seen, kept = OrderedDict.fromkeys(start), []
        for i, key in enumerate(keys):
            if key not in seen:
                if len(seen) >= most:
                    seen.popitem(last=False)
                seen[key] = None
                kept.append(i)
        return kept, list(seen)

    def begin(group: pa.Table) -> pa.Table:
        """What a block makes of an empty memory, and its distinct lines unless they are more than a memory holds."""
        keys = _sorted(group).column("_key").to_pylist()
        distinct = list(dict.fromkeys(keys))
        cols = [pa.array([distinct if len(distinct) <= most else None], digests), pa.array([[]], digests), pa.array([admit(keys, [])[1]], digests)]
        return pa.Table.from_arrays([*(group.column(c).slice(0, 1) for c in at), *cols], names=[*at, "distinct", "start", "leave"])

    def walk(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group.column("_at").to_numpy())))
        before, after, stale, seen = [], [], [], None
        for i in range(group.num_rows):
            row = group.slice(i, 1).to_pylist()[0]
            start = row["before"] if seen is None else seen
            seen, known = row["leave"], row["start"] == start
            if not known and row["distinct"] is not None:
                held = set(start)
                new = [x for x in row["distinct"] if x not in held]
                if known := not new or len(start) + len(new) <= most:
                    seen = start + new
            before.append(start)
            after.append(seen)
            stale.append(not known)
        cols = [*(group.column(c) for c in (*at, "_at", "distinct", "start", "leave")), pa.array(before, digests), pa.array(after, digests), pa.array(stale)]
        return pa.Table.from_arrays(cols, names=[*at, "_at", "distinct", "start", "leave", "before", "after", "stale"])

    def again(key, lines: pa.Table, states: pa.Table) -> pa.Table:
        starts = states.column("before").combine_chunks()
        left = [admit(_sorted(lines).column("_key").to_pylist(), x)[1] for x in starts.to_pylist()]
        return pa.Table.from_arrays([states.column("file"), states.column("_block"), starts, pa.array(left, digests)], names=[*at, "_start", "_leave"])

    def keep(key, lines: pa.Table, states: pa.Table) -> pa.Table:
        lines = _sorted(lines)
        start = states.column("before")[0].as_py() if states.num_rows else []
        kept = admit(lines.column("_key").to_pylist(), start)[0]
        return lines.take(pa.array(kept, pa.int64())).select(["file", "lineno", "line"])

    shape = "file string, _block long, distinct array<binary>, start array<binary>, leave array<binary>"
    several = rows.groupBy("file").agg(F.min("_block").alias("_first"), F.max("_block").alias("_last")).filter("_last > _first").select("file").checkpoint()
    states = df.sparkSession.createDataFrame([], "file string, _block long, before array<binary>")
    if not several.isEmpty():
        keys = rows.join(several, "file", "left_semi").select(*at, "lineno", "_key").checkpoint()
        place = keys.select(*at).distinct().withColumn("_at", F.row_number().over(W.partitionBy("file").orderBy("_block")) - 1)
        known = keys.groupBy(*at).applyInArrow(begin, shape).join(place, at).withColumn("before", F.array().cast("array<binary>"))
        write, shape = _rounds(df.sparkSession), "file string, _block long, _at int, distinct array<binary>, start array<binary>, leave array<binary>, before array<binary>, after array<binary>, stale boolean"
        while True:
            walked = write(known.groupBy("file", F.floor(F.col("_at") / stretch)).applyInArrow(walk, shape))
            edges = walked.filter((F.col("_at") + 1) % stretch == 0).select("file", (F.col("_at") + 1).alias("_at"), F.col("after").alias("_fresh"))
            known = walked.join(edges, ["file", "_at"], "left").withColumn("moved", F.col("_fresh").isNotNull() & (F.col("_fresh") != F.col("before"))).withColumn("before", F.coalesce("_fresh", "before")).drop("_fresh", "after")
            if known.filter("moved or stale").isEmpty():
                break
            stale = known.filter("stale").select(*at, "before")
            new = keys.join(stale, at, "left_semi").groupBy(*at).cogroup(stale.groupBy(*at)).applyInArrow(again, "file string, _block long, _start array<binary>, _leave array<binary>")
            known = known.join(new, at, "left").withColumns({"start": F.coalesce("_start", "start"), "leave": F.coalesce("_leave", "leave")}).drop("_start", "_leave", "moved", "stale")
        states = known.select(*at, "before")
    return rows.groupBy(*at).cogroup(states.groupBy(*at)).applyInArrow(keep, "file string, lineno long, line string")
