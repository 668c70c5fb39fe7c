"""Conversations for training from trees of replies: paths, ranks, one text for each chosen path, and the way back.

A tree's root-to-leaf paths are found by self-joins that double their reach: after k of them every message knows its ancestor 2^k
steps up, so a path of n messages takes log2(n) joins. The same pointers then unfold the chosen leaves into paths, and only these
narrow rows (path, place, message) are joined; texts move twice, to their places and into parts of a path.

A path is formatted as parts of up to ``part_turns`` turns, which together are its text, so that no row holds a whole
conversation of any length. The template::

    <turn ROLE>
    TEXT</turn>

ends each turn with a line feed. In texts a backslash stands before a backslash, ``<turn `` and ``</turn>``, in roles before a
backslash, ``<`` and ``>``, so no text can end its turn or begin another, and reading gives back exactly what was written.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import stored

OPEN, CLOSE = "<turn ", "</turn>"


def escape_text(c: Column) -> Column:
    for part in ("\\", OPEN, CLOSE):
        c = F.replace(c, F.lit(part), F.lit("\\" + part))
    return c


def escape_role(c: Column) -> Column:
    for part in ("\\", "<", ">"):
        c = F.replace(c, F.lit(part), F.lit("\\" + part))
    return c


def opening(role: Column) -> Column:
    return F.concat(F.lit(OPEN), escape_role(F.coalesce(role, F.lit(""))), F.lit(">\n"))


def turn(role: Column, text: Column) -> Column:
    """A turn in the template; null roles and texts are empty ones."""
    return F.concat(opening(role), escape_text(F.coalesce(text, F.lit(""))), F.lit(CLOSE + "\n"))


# -- trees ----------------------------------------------------------------------------------------------------------------


def pointers(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Of links (node, parent, score), parent null at roots: rows (node, depth, total) of all that hang on a root, depth 0 at it,
    total the sum of the scores from the root on; and for each k rows (node, up), ``up`` being 2^k steps above.

    The joins end when no pointer is left. Nodes on a circle, or below one, hang on no root: when the reach exceeds
    the number of nodes, only theirs are left, and they go.
    """
    state = stored(links.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("score").alias("total")), "chat-links")
    n, levels, done = state.count(), [], state.filter("up is null")
    while True:
        open_ = state.filter("up is not null")
        if 1 << len(levels) > n or open_.isEmpty():
            return done.drop("up"), levels
        levels.append(open_.select("node", "up"))
        # what lies ahead of the pointer is added to what lies before it; nodes that have reached their root wait aside
        ahead = open_.unionByName(done).select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        joined = open_.join(ahead, "up")
        state = stored(joined.select("node", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("total") + F.col("_total")).alias("total")), "chat-reach")
        done = done.unionByName(state.filter("up is null"))


def unfold(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Rows (path, node, place) of all messages from the root to each leaf of ``leaves`` (node, depth), the leaf naming the path."""
    out = leaves.select(F.col("node").alias("path"), "node", F.col("depth").alias("place"))
    for k in range(len(levels) - 1, -1, -1):  # every number of steps is one sum of powers of two
        up = F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place")))
        both = F.explode(F.array_compact(F.array(F.struct("node", "place"), up))).alias("at")
        out = out.join(levels[k], "node", "left").select("path", both).select("path", "at.node", "at.place")
    return out


def paths(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """Rows (conv_id, path, rank, node, place): the messages of each chosen path, ``place`` from 0 at the root.

    ``messages`` has conv_id, node (unique, not null), parent (null at roots, else of the same conversation) and score.
    A conversation's branches rank by the mean score of their messages, of equal ones the longer first, then that of the smaller
    leaf; the best ``keep`` are chosen, or all.
    """
    reached, levels = pointers(messages.select("node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    inner = messages.filter("parent is not null").select(F.col("parent").alias("node")).distinct()
    leaves = reached.join(inner, "node", "left_anti").join(messages.select("node", "conv_id"), "node")
    best = W.partitionBy("conv_id").orderBy(F.desc(F.col("total") / (F.col("depth") + 1)), F.desc("depth"), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(best))
    if keep is not None:
        ranked = ranked.filter(F.col("rank") <= keep)
    ranked = stored(ranked.select("node", "depth", "conv_id", "rank"), "chat-leaves")
    names = ranked.select(F.col("node").alias("path"), "conv_id", "rank")
    return unfold(ranked.select("node", "depth"), levels).join(names, "path").select("conv_id", "path", "rank", "node", "place")


# -- formatting -----------------------------------------------------------------------------------------------------------


def formatted(chosen: DataFrame, messages: DataFrame, part_turns: int = 64, learn: str = "assistant") -> DataFrame:
    """Rows (conv_id, path, rank, part, text, loss): ``chosen`` as ``paths`` gives it, with role and text of ``messages`` (node).

    A path's parts, in order, are its text. ``loss`` holds spans (start, end) in code points of the part: the texts of the role ``learn``.
    """
    said = chosen.join(messages.select("node", "role", "text"), "node")
    own, begin = turn(F.col("role"), F.col("text")), F.when(F.col("role") == learn, F.char_length(opening(F.col("role"))))
    rows = said.select("conv_id", "path", "rank", F.floor(F.col("place") / part_turns).cast("long").alias("part"), F.struct("place", own.alias("turn"), begin.alias("begin")).alias("t"))
    parts = rows.groupBy("conv_id", "path", "rank", "part").agg(F.sort_array(F.collect_list("t")).alias("ts"))  # part_turns at most
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    tail = len(CLOSE) + 1

    def add(s: Column, t: Column) -> Column:
        end = s["at"] + F.char_length(t["turn"])
        span = F.struct((s["at"] + t["begin"]).alias("start"), (end - tail).alias("end"))
        return F.struct(end.alias("at"), F.when(t["begin"].isNull(), s["spans"]).otherwise(F.concat(s["spans"], F.array(span))).alias("spans"))

    return parts.select("conv_id", "path", "rank", "part", F.array_join(F.transform("ts", lambda t: t["turn"]), "").alias("text"), F.aggregate("ts", start, add, lambda s: s["spans"]).alias("loss"))


def format_trees(messages: DataFrame, keep: int | None = None, part_turns: int = 64, learn: str = "assistant") -> DataFrame:
    """Trees of replies as conversations: rows (conv_id, path, rank, part, text, loss), see ``paths`` and ``formatted``.

    ``messages`` has conv_id, id, parent_id, role, text and score. A message whose parent is null, missing, itself, or in another
    conversation is a root; messages on a circle have no root and go, with what hangs on them. Null conv_ids are one conversation, null
    scores 0, null roles and texts empty. A message without an id is left out; of several rows with one id that of the least
    (conv_id, parent_id, role, text, score) counts. An empty table gives an empty one; further columns are left out.
    Needs the shared checkpoint folder.
    """
    cols = ["conv_id", "parent_id", "role", "text", "score"]
    one = messages.filter("id is not null").groupBy(F.col("id").alias("node")).agg(F.min(F.struct(*cols)).alias("m")).select("node", "m.*")
    one = stored(one, "chat-messages")
    above = one.select(F.col("node").alias("parent_id"), F.col("conv_id").alias("_conv"), F.lit(True).alias("_there"))
    narrow = one.select("conv_id", "node", "parent_id", "score").join(above, "parent_id", "left")
    real = F.col("_there") & F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("parent_id") != F.col("node"))
    narrow = stored(narrow.select("conv_id", "node", F.when(real, F.col("parent_id")).alias("parent"), "score"), "chat-tree")
    return formatted(paths(narrow, keep), one, part_turns, learn)


def format_turns(turns: DataFrame, part_turns: int = 64, learn: str = "assistant") -> DataFrame:
    """Conversations without branches: rows (conv_id, turn, role, text), each turn answering the one before it.

    Turns of one number follow in the order of role and text, null numbers come first; each row is a turn, equal ones too. Else as
    ``format_trees``. The rows are ordered in ranges, so that a conversation of any length is many tasks' work.
    """
    rows = stored(placed(turns.select("conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "text"), "chat-turns").withColumnRenamed("place", "node")
    ids = rows.select("conv_id", "node")
    before = ids.select((F.col("node") + 1).alias("node"), F.col("conv_id").alias("_conv"), F.lit(True).alias("_there"))
    follows = F.col("_there") & F.col("_conv").eqNullSafe(F.col("conv_id"))
    narrow = ids.join(before, "node", "left").select("conv_id", "node", F.when(follows, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"))
    return formatted(paths(stored(narrow, "chat-tree")), rows, part_turns, learn)


def placed(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``place``, the number of each row from 1 in the order given; rows that agree in it all are interchangeable.

    Rows are sorted in ranges, and each adds the counts of the ranges before it, a row for each.
    """
    rows = stored(df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*(F.col(c).asc_nulls_first() for c in order), "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "placed")
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    sizes = rows.groupBy("_range").count()
    ahead = sizes.select("_range", F.coalesce(F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return rows.join(F.broadcast(ahead), "_range").select(*df.columns, (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_ahead") + 1).alias("place"))


# -- reading back ---------------------------------------------------------------------------------------------------------


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.DOTALL)


def _unescaped_at(s: str, what: str, at: int) -> int:
    """Where ``what`` stands from ``at`` on without a backslash of its own ahead of it; -1 if nowhere."""
    while (found := s.find(what, at)) >= 0:
        back = found
        while back > at and s[back - 1] == "\\":
            back -= 1
        if (found - back) % 2 == 0:
            return found
        at = found + 1
    return -1


def read_turns(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted part."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        head = _unescaped_at(text, ">", at + len(OPEN))
        end = _unescaped_at(text, CLOSE, head + 2)
        if head < 0 or end < 0 or text[head + 1] != "\n":
            raise ValueError(f"the turn at {at} does not end")
        out.append((unescape(text[at + len(OPEN) : head]), unescape(text[head + 2 : end])))
        at = end + len(CLOSE) + 1
    return out


def digests(parts: DataFrame) -> DataFrame:
    """What formatted parts say when read back: rows (conv_id, path, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    A path's parts pass by one task in their order, one at a time, and only its running digests are held.
    """
    schema = "conv_id long, path long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, None

        def close() -> list:
            n, turns, chars, loss, size = sums
            return [*key, n, turns.hexdigest(), chars, loss.hexdigest(), size]

        for batch in batches:
            done = []
            for conv, path, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "text", "loss")), strict=True):
                if key != (conv, path):
                    if key is not None:
                        done.append(close())
                    key, sums = (conv, path), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    sums[0] += 1
                    sums[1].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    learnt = unescape(text[span["start"] : span["end"]])
                    sums[2] += len(learnt)
                    sums[3].update(learnt.encode())
                sums[4] += len(text)
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string() if "sha256" in n else pa.int64()) for i, n in enumerate(names)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if "sha256" in n else pa.int64()) for v, n in zip(close(), names, strict=True)], names=names)

    rows = parts.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("path").cast("long").alias("path"), "part", "text", "loss")
    return rows.repartition("path").sortWithinPartitions("path", "part").mapInArrow(run, schema)
