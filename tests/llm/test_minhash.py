import random
import re

from pyspark.sql import types as T

from tidemark.llm import graphs, minhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("key", T.StringType())])


def sets(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    s = {i: sets(t) for i, t in docs}
    root = {i: i for i in s}
    ids = sorted(s)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and s[a] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return {(i, len(s[i]), root[i], root[i] == i) for i in ids}


def corpus():
    r = random.Random(3)
    words = [f"W{i}é" for i in range(400)]
    docs, base = [], [" ".join(r.choice(words) for _ in range(n)) for n in (30, 60, 120, 200, 7, 5, 400)]
    passage = " ".join(r.choice(words) for _ in range(60))
    for _ in range(160):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            w[r.randrange(len(w))] = r.choice(words)
        docs.append(r.choice([" ", "\n", "  "]).join(w).upper() if r.random() < 0.2 else " ".join(w))
    docs += [passage + " " + " ".join(r.choice(words) for _ in range(50)) for _ in range(30)]
    docs += [None, "", " \n", "one", "ONE", "one two", "one two three four", "x " * 5000, "x " * 5000 + "y"]
    r.shuffle(docs)
    return list(enumerate(docs, 10))


def test_components_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], SCHEMA)
    got = {tuple(r) for r in minhash.near_duplicates(df).collect()}
    assert got == brute(docs)
    tiles = {tuple(r) for r in minhash.near_duplicates(df, tile_bytes=4000).collect()}
    assert tiles == got
    kept = {r.doc_id for r in minhash.keep_one(df).collect()}
    assert kept == {x[0] for x in got if x[3]}


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f", 1, None), (None, "a b c d e f", 1, None), (7, "a b c d e f", 1, "z"), (7, "a b c d e f", 1, "z"), (3, "A b c d e f", None, "z")]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 2, None, True)] * 2 + [(7, 2, 3, False)] * 2 + [(3, 2, 3, True)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(120)) for c in "ab")
    rows = [(7, a, 1, None), (7, b, 1, None), (7, None, 1, None), (3, a + " z", 1, None), (9, b + " z", 1, None), (8, a + " y", 1, None), (8, "q", 1, None), (12, "q", 1, None), (2, "w", 1, None)]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(7, 3), (3, 3), (9, 3), (8, 3), (12, 3), (2, 2)}


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in graphs.components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}
