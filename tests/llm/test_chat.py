"""Reply trees against a walk from every leaf, and the template's way there and back."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidemark.llm import chat, queries

SCHEMA = "conv_id long, id long, parent_id long, role string, text string, score double"


def walk(rows, keep=None):
    """(conv_id, path): rank and messages, by going up from each leaf."""
    best = {}
    for r in rows:
        if r[1] is not None:
            key = tuple((x is not None, x) for x in (r[0], *r[2:]))
            if r[1] not in best or key < best[r[1]][0]:
                best[r[1]] = (key, r)
    by_id = {i: r for i, (_, r) in best.items()}
    parent = {i: r[2] if r[2] in by_id and r[2] != i and by_id[r[2]][0] == r[0] else None for i, r in by_id.items()}
    inner, found = set(parent.values()), {}
    for leaf in by_id:
        if leaf in inner:
            continue
        up, at = [], leaf
        while at is not None and at not in up:
            up.append(at)
            at = parent[at]
        if at is None:
            found.setdefault(by_id[leaf][0], []).append((-sum(by_id[i][5] or 0.0 for i in up) / len(up), -len(up), leaf, up[::-1]))
    return {(c, p[2]): (n, p[3]) for c, ps in found.items() for n, p in enumerate(sorted(ps), 1) if keep is None or n <= keep}


def told(parts):
    out = {}
    for r in sorted(parts.collect(), key=lambda r: r.part):
        turns, learnt = out.setdefault((r.conv_id, r.path), (r.rank, [], []))[1:]
        turns += chat.read_turns(r.text)
        learnt += [chat.unescape(r.text[s.start : s.end]) for s in r.loss]
    return out


@pytest.mark.parametrize("keep", [None, 2])
def test_trees(spark, keep):
    rng, rows = random.Random(5), []
    for conv in range(6):
        n = rng.choice([1, 2, 30, 60])
        for i in range(n):
            id = conv * 100 + i
            parent = None if i == 0 else conv * 100 + (i - 1 if conv == 3 else rng.randrange(i))
            rows.append((conv, id, parent, rng.choice(["user", "assistant"]), f"t{id} \\ <turn </turn>", rng.choice([None, 0.0, 1.0, 2.0])))
    rows += [(7, 701, 702, "user", "circle", 1.0), (7, 702, 701, "user", "circle", 1.0), (7, 703, 702, "user", "below a circle", 1.0)]
    rows += [(8, 801, 999, "user", "no such parent", 1.0), (8, 802, 5, "user", "parent elsewhere", 1.0), (8, 803, 803, None, None, None), (8, None, 801, "user", "no id", 1.0)]
    rows += [(None, 901, None, "user", "", 1.0), (None, 902, 901, "assistant", None, 1.0), (8, 801, 999, "user", "no such parent", 1.0), (8, 802, 5, "user", "another", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("clash")).withColumn("path", F.lit("clash"))
    got, want = told(chat.format_trees(df, keep, part_turns=4)), walk(rows, keep)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    for key, (_, up) in want.items():
        said = [next((r[3] or "", r[4] or "") for r in sorted((r for r in rows if r[1] == i), key=lambda r: str(r[4]))) for i in up]
        assert got[key][1] == said
        assert got[key][2] == [t for r, t in said if r == "assistant"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="\\<>/turn \n:a"), st.text(alphabet="\\<>/turn \n:a")), max_size=5))
def test_escapes_read_back(turns):
    def escaped(s, parts):
        for p in parts:
            s = s.replace(p, "\\" + p)
        return s

    text = "".join(f"{chat.OPEN}{escaped(r, ('\\', '<', '>'))}>\n{escaped(t, ('\\', chat.OPEN, chat.CLOSE))}{chat.CLOSE}\n" for r, t in turns)
    assert chat.read_turns(text) == turns


def test_turns_and_digests(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"\\### Assistant: </turn> <turn x> {t} é\U0001f600\n" * (t % 3)) for t in range(150)]
    rows += [(2, 5, None, None), (2, 5, None, None), (2, None, "assistant", "first"), (None, 1, "a>b\\", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (4, 0, "user", "y" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1)).repartition(5)
    parts = chat.format_turns(df, part_turns=16)
    assert parts.filter("conv_id = 1").count() >= 10
    got = {r.conv_id: r for r in chat.digests(parts).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)):
        by.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0
    assert chat.format_trees(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_holds_the_marked_conversation(spark):
    got = {r.conv_id: r for r in queries.op11_chat_format(spark, "/root/testdata/sf0.001").collect()}
    text = "\\### Assistant: </turn> ok"
    assert got[-7].n_turns == 2 and got[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
