import re

import numpy as np
from pyspark.sql import types as T

from tidemark.llm import mixing

SCHEMA = T.StructType([T.StructField(n, T.LongType() if n == "doc_id" else T.StringType()) for n in ("doc_id", "text", "source", "taken")])


def rows():
    out = [(i, " ".join(f"w{j}" for j in range(1 + i * 7 % 90)), ["b", "a", None, "ä", "c"][i % 5], "x") for i in range(300)]
    return out + [(900, "w " * 9000, "b", "x"), (901, None, "a", None), (902, "", "empty", None), (903, " \n", None, None), (None, "a b c", "a", None), (7, "a b", "a", None), (7, "a b", "a", None)]


def oracle(docs, weights=(5, 2, 1), share=1.5):
    size = {}
    for _, t, s, _ in docs:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, goal = share * sum(size.values()), [s for s in names if size[s]], dict.fromkeys(names, 0.0)
    while True:
        part = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if part[s] > 2 * size[s]]
        if not over:
            return size, goal | part
        for s in over:
            goal[s] = 2.0 * size[s]
            left -= goal[s]
            free.remove(s)


def total(pieces, key):
    out = {}
    for p in pieces:
        out[key(p)] = out.get(key(p), 0) + p.taken
    return out


def test_words_taken(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    result = mixing.mix(df, block_words=5, least_shards=7, cell_rows=16)
    size, goal = oracle(rows())
    got = mixing.taken_words(result).collect()
    assert len(got) == len(rows()) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert all((r.shard is None) == (r.taken == 0) for r in got)
    assert {r.source: (r.source_size, round(r.target, 6)) for r in result.sources.collect()} == {s: (size[s], round(goal[s], 6)) for s in size}
    pieces = result.pieces.collect()
    words = total(pieces, lambda p: p.source)
    assert all(words.get(s, 0) == round(goal[s]) for s in size)
    for shard in range(7):
        assert sorted(p.position for p in pieces if p.shard == shard) == list(range(sum(p.shard == shard for p in pieces)))
    spans = {}
    for p in pieces:
        spans.setdefault((p.id, p.source, p.size, p.print, p.nth, p.copy), []).append((p.begin, p.begin + p.taken))
    for (_, _, n, *_), runs in spans.items():
        runs.sort()
        assert runs[0][0] >= 0 and runs[-1][1] <= n and all(a[1] <= b[0] for a, b in zip(runs, runs[1:], strict=False))
    per = list(total(pieces, lambda p: p.shard).values())
    assert len(per) == 7 and max(per) - min(per) <= 2 * 9000 / 5  # a block of the largest source, in each pass, is the most that shards differ by


def test_reruns_agree(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    options = {"block_words": 5, "least_shards": 7, "cell_rows": 16}
    one, two = (mixing.taken_words(mixing.mix(x, **options)).collect() for x in (df.repartition(3), df.orderBy("text").coalesce(1)))
    assert sorted(map(str, one)) == sorted(map(str, two))
    one, two = (mixing.mixed_texts(x, **options).collect() for x in (df.repartition(3), df.orderBy("text").coalesce(1)))
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_the_split_decides(spark, monkeypatch):
    """Other quotas for the shards give other blocks."""
    df = spark.createDataFrame(rows(), SCHEMA)
    one = mixing.taken_words(mixing.mix(df, block_words=5, least_shards=7)).select("id", "size", "taken").collect()

    def slanted(quotas, shards, seed):
        out = np.zeros((len(quotas), shards), np.int64)
        out[:, 0], out[:, 1] = [q - q // 3 for q in quotas], [q // 3 for q in quotas]
        return out

    monkeypatch.setattr(mixing, "split_quotas", slanted)
    two = mixing.taken_words(mixing.mix(df, block_words=5, least_shards=7)).select("id", "size", "taken").collect()
    assert sorted(map(str, one)) != sorted(map(str, two))
    assert sum(r.taken for r in one) == sum(r.taken for r in two)


def test_texts(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = mixing.mixed_texts(df, block_words=50, least_shards=3).collect()
    _, goal = oracle(rows())
    for s, t in goal.items():
        assert sum(len(r.text.split()) for r in out if r.source == s) == round(t)
    assert out[0].asDict().keys() == {"doc_id", "text", "source", "taken"}
    whole = {(d, s): (t or "").split() for d, t, s, _ in rows() if d != 7}
    for r in out:
        if (r.doc_id, r.source) in whole:
            words, part = whole[r.doc_id, r.source], r.text.split()
            assert any(words[i : i + len(part)] == part for i in range(len(words) - len(part) + 1))
    assert mixing.mixed_texts(df.limit(0)).count() == 0
    assert mixing.taken_words(mixing.mix(df.filter("text is null"))).count() == sum(t is None for _, t, *_ in rows())


def test_quotas():
    q = [1000, 10, 0, 333]
    split = mixing.split_quotas(q, 9, 1)
    assert split.sum(axis=1).tolist() == q and np.ptp(split.sum(axis=0)) <= 1 and (split >= 0).all()
    means = np.mean([mixing.split_quotas([80, 20], 4, s)[1] for s in range(400)], axis=0)
    assert np.allclose(means, 5, atol=0.35)
    assert mixing.split_quotas([5_000_000_000, 3], 2, 1).sum(axis=1).tolist() == [5_000_000_000, 3]
    assert mixing.targets([10, 10, 100], [5, 2, 1], 180) == [20.0, 20.0, 140.0]


def test_draws_are_exact():
    """Against exact probabilities, and spread as they should be where counts are beyond a billion."""
    from math import comb

    good, bad, draws = 13, 9, 11
    exact = [comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) for k in range(draws + 1)]
    us = (np.arange(40_000) + 0.5) / 40_000
    got = np.bincount([mixing.hypergeometric(good, bad, draws, u) for u in us], minlength=draws + 1) / len(us)
    assert np.allclose(got, exact, atol=3e-5)
    big = [mixing.hypergeometric(3_000_000_000, 5_000_000_000, 4_000_000_000, u) for u in np.random.default_rng(1).random(300)]
    spread = (4e9 * (3 / 8) * (5 / 8) * (4 / 8)) ** 0.5
    assert abs(np.mean(big) - 1.5e9) < 4 * spread / 300**0.5 and 0.85 < np.std(big) / spread < 1.15
