"""Importance resampling against features, weights and ranks counted anew."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tidemark.llm import importance, queries

SF = "/root/testdata/sf0.001"


def features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in (text or "").encode()))
    return len(words), [zlib.crc32(b" ".join(words[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def drawn(docs, target):
    """Sorted rows (doc_id, n_features, weight, score, rank)."""
    told = [(i, *features(t)) for i, t in docs]
    own, other = Counter(b for _, _, fs in told for b in fs), Counter(b for t in target for b in features(t)[1])
    s, t = sum(own.values()), sum(other.values())
    gain = {b: math.floor(1000 * math.log((other[b] + 1) * (s + 10_000) / ((own[b] + 1) * (t + 10_000)))) for b in own}
    rows = []
    for i, n, fs in told:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in fs)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(fit[: 5 * len(fit) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op13_importance_resampling(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == drawn(docs, target)


def test_odd_rows(spark):
    docs = [(i, f"Ab{i % 7} c\u00e9_{i % 5} x-1 " * (1 + i % 9)) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "--"), (None, "null id " * 30), (None, None), (5, docs[5][1]), (5, docs[5][1]), (6, "again " * 25), (1003, "deep sea " * 40_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("rank", F.lit("clash")).repartition(4)
    target = ["Ab1 c\u00e9", None, "x-1 deep"]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long")
    assert sorted(map(tuple, importance.resample(df, goal).collect()), key=repr) == drawn(docs, target)
    assert importance.resample(df.limit(0), goal).count() == 0
    assert sorted(map(tuple, importance.resample(df, goal.limit(0)).collect()), key=repr) == drawn(docs, [])
    few = df.filter("doc_id < 10")
    assert all(r.rank is None for r in importance.resample(few, goal, per_cent=1).collect())


def test_pieces_cut_no_run():
    text = " ".join(f"w{i}" for i in range(500)).encode()
    whole = list(importance._hashes(text, 3))
    size, importance._PIECE = importance._PIECE, 50
    importance.pieces.__defaults__ = (50,)
    try:
        cut = list(importance._hashes(text, 3))
    finally:
        importance._PIECE = size
        importance.pieces.__defaults__ = (size,)
    for n in range(3):
        assert whole[n].tolist() == [h for part in cut[n::3] for h in part.tolist()]
    assert len(cut) > 3


@pytest.mark.parametrize("coarse", [1, 7, 1 << 16])
def test_offsets(spark, coarse):
    scores = [(i * i) % 57 - 20 for i in range(200)]
    got = {r.score: (r.n, r.above) for r in importance.offsets(spark.createDataFrame([(s,) for s in scores], "score long"), coarse).collect()}
    assert got == {s: (scores.count(s), sum(x > s for x in scores)) for s in scores}
