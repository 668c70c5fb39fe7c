import hashlib
import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts, per_cent):
    """The smallest id of each document's group, from all pairs."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}


def test_near_dedup_stage_equals_brute_force(spark):
    r, texts = random.Random(11), {}
    for n in range(60):
        base = [f"w{r.randrange(3000)}" for _ in range(204)]
        near = list(base)
        for at in range(30, 30 + 40 * (n % 5), 40):  # each changed word takes five shingles of 200
            near[at] = "changed"
        texts |= {2 * n: " ".join(base), 2 * n + 1: " ".join(near)}
    want = groups(texts, 80)
    assert want != groups(texts, 85)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    kept = {row.doc_id for row in STAGES["MinHash near-dedup"](spark, docs, SF).collect()}
    assert kept == {i for i in texts if want[i] == i}


def test_stages_in_turn(spark):
    """On the smallest tables: filters keep rows as they are, near-duplicates go as by brute force, each row is encoded whole."""
    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF).checkpoint()
        after = docs.collect()
        sizes.append(len(after))
        if name in ("language ID", "quality classifier"):
            assert after and set(after) <= set(before)
        if name == "MinHash near-dedup":
            root = groups({x.doc_id: x.text for x in before}, 80)
            assert set(after) == {x for x in before if root[x.doc_id] == x.doc_id}
        if name == "mixing sources":
            texts = {x.doc_id: set(re.findall(r"\S+", x.text)) for x in before}
            assert after and all(set(re.findall(r"\S+", x.text)) <= texts[x.doc_id] and x.n_chars == len(x.text) for x in after)
        if name == "BPE encoding":
            assert sorted((x.doc_id, x.decoded_sha256) for x in after) == sorted((x.doc_id, hashlib.sha256(x.text.encode()).hexdigest()) for x in before)
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]
    assert docs.filter(F.col("n_tokens") <= 0).isEmpty()


def test_stages_keep_further_columns_and_take_odd_rows(spark):
    """Ties, repeated rows, null ids and columns whose names the operators use, in every stage; then an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    one = docs.first()
    odd = spark.createDataFrame([(None, one.text, one.lang, one.source, one.n_chars), (one.doc_id, one.text, one.lang, one.source, one.n_chars), (10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0)], docs.schema)
    clash = docs.unionByName(odd).withColumn("score", F.lit("own")).withColumn("size", F.lit(1)).withColumn("lang_pred", F.lit("own"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, clash, SF)
        assert got.columns == clash.columns, name
        rows = got.collect()
        assert rows and all(r.score == "own" and r["size"] == 1 and r.lang_pred == "own" for r in rows), name
        if name == "language ID":
            assert all(r.doc_id not in (10**9, 10**9 + 1) for r in rows)
        if name == "MinHash near-dedup":
            assert any(r.doc_id is None for r in rows)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
