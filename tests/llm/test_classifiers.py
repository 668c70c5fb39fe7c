import random

import numpy as np
from pyspark.sql import types as T

from tidemark.llm import langid, quality

DOCS = T.StructType([T.StructField(n, T.LongType() if n == "doc_id" else T.StringType()) for n in ("doc_id", "text", "lang", "score")])
WORDS = {"xx": ["the", "of", "that", "thing", "with", "hat"], "yy": ["der", "schach", "über", "keit", "und", "ein"], "zz": ["que", "ción", "asta", "ñas", "los", "ella"]}


def documents(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        out.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(1, 60))) + ".", lang, "x"))
    return out


def test_languages_of_held_out_texts(spark):
    model = langid.fit(spark.createDataFrame(documents(300) + [(None, None, "xx", None), (9999, "x", None, None)], DOCS))
    rows = langid.predict(spark.createDataFrame(documents(200, 2), DOCS), model).collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 198
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 4
    odd = [(1, None, None, None), (2, "", "xx", None), (3, "12 34 !!", None, None), (None, "the of that", None, None), (5, "the of " * 200_000, None, None), (5, "the of " * 200_000, None, None)]
    got = langid.predict(spark.createDataFrame(odd, DOCS), model).collect()
    assert [(r.lang_pred, r.rejected) for r in got] == [("und", True)] * 3 + [("xx", False)] * 3
    assert langid.predict(spark.createDataFrame([], DOCS), None).count() == 0
    assert langid.fit(spark.createDataFrame([], DOCS)) is None


def test_counts_of_slices_equal_those_of_the_whole(monkeypatch):
    text = "Über the hill " * 40
    whole = langid.bag(text, 12)
    monkeypatch.setattr(langid, "_SLICE", 7)
    assert np.array_equal(langid.bag(text, 12), whole)
    n = len(text.encode()) + 2
    assert whole.sum() == sum(n - k + 1 for k in langid.ORDERS)


def test_quality_of_held_out_texts(spark):
    r = random.Random(4)
    prose = lambda: "\n".join(" ".join(r.choice(WORDS["xx"]) for _ in range(r.randint(4, 12))).capitalize() + "." for _ in range(r.randint(1, 9)))
    junk = lambda: " ".join(r.choice(["BUY!!", "$$$", "###", "click|", "%%%x"]) for _ in range(r.randint(5, 60)))
    docs = [(i, prose() if i % 3 else junk(), None, "old") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(1, None), (None, 1), (7777, 0)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, DOCS)
    model = quality.fit(df, labels)
    rows = quality.score(df.filter("doc_id >= 300"), model).collect()
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in rows) >= 297
    odd = quality.score(spark.createDataFrame([(1, None, None, None), (2, "", None, None), (None, "a " * 300_000, None, None)], DOCS), model).collect()
    assert odd[0].score == odd[1].score and all(0 <= r.score <= 1 for r in odd)
    assert quality.fit(df, labels.filter("quality = 1")) is None
    assert [r.score for r in quality.score(df.limit(2), None).collect()] == [0.5, 0.5]


def test_scores_are_ratios_of_gaussian_densities():
    r = np.random.default_rng(0)
    x = np.vstack([r.normal(0, 1, (300, 3)), r.normal(1, 2, (200, 3))])
    y = np.repeat([0, 1], [300, 200])
    m = quality.fit_arrays(x, y, shrinkage=0, pooling=0)
    z = (x - m.mean) / m.scale
    dens = []
    for c in (0, 1):
        s = np.cov(z[y == c], rowvar=False, bias=True)
        d = z - z[y == c].mean(axis=0)
        dens.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    want = 1 / (1 + np.exp(-(dens[1] - dens[0]) / m.temperature))
    assert np.allclose(m.scores(x), want, atol=1e-6)


def test_languages_of_long_or_few_texts_are_learned(spark):
    r = random.Random(8)
    text = lambda lang, n: " ".join(r.choice(WORDS[lang]) for _ in range(n))
    rows = [(i, text("xx", 30), "xx", None) for i in range(900)] + [(2000 + i, "12 " * 9000 + text("yy", 9000), "yy", None) for i in range(3)] + [(3000 + i, text("zz", 20), "zz", None) for i in range(4)]
    model = langid.fit(spark.createDataFrame(rows, DOCS), sample_rows=90)
    assert model.langs == ("xx", "yy", "zz")
    assert [model.predict(text(lang, 40))[0] for lang in model.langs] == list(model.langs)


def test_prediction_equals_brute_force(spark):
    """Byte n-grams one by one, their hashes in whole numbers, embeddings summed: the same language and score."""
    model = langid.fit(spark.createDataFrame(documents(120), DOCS))
    texts = [t for _, t, _, _ in documents(20, 3)] + ["Über 12 ñ!", "a", "é" * 50]
    for text in texts:
        data = b" " + bytes(c if chr(c).isalpha() or c > 127 else 32 for c in text.encode().lower()) + b" "
        total, n = np.zeros(len(model.langs)), 0
        for size in langid.ORDERS:
            for at in range(len(data) - size + 1):
                h = 0
                for k in range(1, size + 1):
                    h = (h * 0x01000193 + data[at + k - 1] + k) % 2**32
                total += model.table[(h * 0x9E3779B1) % 2**32 >> (32 - model.bits)]
                n += 1
        z = (total / n + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        lang, score = model.predict(text)
        assert lang == model.langs[int(p.argmax())] and abs(score - p.max()) < 1e-4


def test_bounded_samples(spark):
    from tidemark.llm.common import bounded_sample

    same = spark.range(20_000).selectExpr("7L as id", "'x' as lang")
    rows, n = bounded_sample(same, ["id"], 100)
    assert n == 1 and [r.id for r in rows.collect()] == [7]
    few = spark.range(20_000).selectExpr("if(id % 3 = 0, null, id % 50) as id", "'x' as lang")
    assert bounded_sample(few, ["id"], 100)[0].count() == 51
    many = spark.range(20_000).selectExpr("id", "if(id < 5, 'rare', if(id % 2 = 0, 'a', null)) as lang")
    rows, n = bounded_sample(many, ["id"], 600)
    assert abs(n - 20_000) < 800 and 500 < rows.count() < 700
    by = {r["lang"]: r["count"] for r in bounded_sample(many, ["id", "lang"], 600, by="lang")[0].groupBy("lang").count().collect()}
    assert by["rare"] == 5 and 140 < by["a"] < 260 and 140 < by[None] < 260
    assert bounded_sample(many.limit(0), ["id"], 5)[0].count() == bounded_sample(many.limit(0), ["id"], 5, by="lang")[0].count() == 0
    hot = spark.createDataFrame([(1, "a text %d." % i, None, None) for i in range(500)] + [(2, "BUY!!", None, None), (3, "a b.", None, None), (4, "$$", None, None)], DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    assert quality.fit(hot, labels) is not None
