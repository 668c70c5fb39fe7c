"""WAND against a full ranking of every document."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F
from tidemark.llm import lexical


def ranked(docs, items, k):
    terms = lambda s: re.findall(rb"[0-9a-z\x80-\xff]+", bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in s.encode()))
    held = [(i, terms(t or "")) for i, t in docs]
    held = [(i, ts) for i, ts in held if ts]
    n, total = len(held), sum(len(ts) for _, ts in held)
    asked = {}
    for i, t in dict.fromkeys(items):
        asked.setdefault(i, []).extend(terms(t or ""))
    out = {}
    for item, wanted in asked.items():
        rows = []
        for i, ts in held:
            m, score = 25 + 75 * len(ts) * n // total, 0
            for t in wanted:
                if tf := ts.count(t):
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in o for _, o in held) + 1)))
                    score += w * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out |= {(item, r): (None if null else i, -s) for r, (s, null, i) in enumerate(sorted(rows)[:k], 1)}
    return out


@pytest.mark.parametrize(("shard", "pass_bytes"), [(7, 8 << 20), (1000, 40)])
def test_against_full_ranking(spark, shard, pass_bytes):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["Él", "über", "x1"]
    pick = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, pick(rng.randrange(1, 40)).replace(" ", rng.choice([" ", "\n", ", ", "_"]))) for i in range(120)]
    docs += [(200 + i, docs[3][1]) for i in range(15)] + [(500, None), (501, ""), (502, "--"), (503, "w0 " * 60_000), (None, docs[3][1]), (3, docs[3][1]), (504, "W0W1 w2")]
    rng.shuffle(docs)
    items = [(i, pick(rng.randrange(1, 12))) for i in range(12)] + [(20, docs[0][1] or "w1"), (21, None), (22, "nowhere else"), (23, ""), (None, "w1 w1 w3"), (0, "w5 W6"), (20, docs[0][1] or "w1")]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("item_id", F.lit("clash")).repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    found = lexical.search(left, right.select("item_id", "text"), k=10, shard_docs=shard, pass_bytes=pass_bytes)
    assert {(r.item_id, r.rank): (r.doc_id, r.score) for r in found.collect()} == ranked(docs, items, 10)


def test_skips_what_cannot_win():
    read = []

    class Counted(list):
        def __getitem__(self, i):
            read.append(i)
            return super().__getitem__(i)

    rare, common = ([5, 900], [90, 95]), (list(range(1000)), Counted([1] * 1000))
    got = lexical.wand([(1, 95, *rare), (1, 1, *common)], 2)
    assert sorted(got) == [(91, 5), (96, 900)] and len(read) < 20


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, items).count() == 1
