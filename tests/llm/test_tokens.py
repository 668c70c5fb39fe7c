import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm import bpe, common, pieces, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "   \n\n  x", "Hello world's  end", "it'll we've 'tis I'D", "<|endoftext|>", "a<|endoftext|>b !<|endoftext|><|endoftext|> ",
    "éèê ça naïve", "²½ x⁴", "日本語テキスト", "😀 emoji 👩‍👩‍👧", "\x1c\x1d a", "tab\there\r\nline nbsp\u0085", "a" * 3000, "word " * 900 + "\n" * 50, "x_y__z 12ab34",
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def rows(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", None), (3, TEXTS[3], "again")], SCHEMA)


def test_counts_equal_the_library(spark, library):
    got = token_counts.count_tokens(rows(spark), limit=3).collect()
    want = [(i, t or "") for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, TEXTS[3])]
    want = [(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 3) for i, t in want]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(rows(spark).limit(0)).count() == 0


def test_the_first_tier_holds_lengths_of_frequent_pre_tokens(spark, library):
    words = ["ththandheed", " zqzqzqzqzq", " the"]  # of several tokens, and of one
    df = spark.createDataFrame([(i, w * 9 + f" rare{i}") for i in range(40) for w in words[1:]], "doc_id long, text string")
    table = token_counts.frequent_lengths(df, "text", PATH, size=2, sample_rows=1000, sample_chars=100)
    assert table == {w: len(library.encode(w, add_special_tokens=False).ids) for w in words[1:]} and table[words[1]] > 1
    counted = {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(df, table_size=2).collect()}
    assert counted == {(r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids)) for r in df.collect()}


def test_a_sample_opens_some_of_the_files_only(spark, tmp_path):
    df = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text", "id AS _metadata")
    df.repartition(40).write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    some = common.some_files(back.select("doc_id", "text"), 10)
    assert 3 <= len(some.select(F.input_file_name()).distinct().collect()) <= 20 and some.rdd.getNumPartitions() < back.rdd.getNumPartitions()
    assert 0 < common.some_files(back, 10).count() < 400  # a column that bears the metadata's name
    assert common.some_files(back, 100).count() == 400
    assert common.some_files(back.groupBy("text").count(), 10).count() == 400  # more than a scan
    assert token_counts.frequent_lengths(back, "text", PATH, size=1, sample_rows=2000, sample_chars=100, sample_files=10)
    assert token_counts.count_tokens(back, sample_files=1).count() == 400


def test_lengths_stay_with_the_worker():
    one = token_counts.worker_lengths("k1", PATH, lambda: {" the": 1}, 10)
    assert one[" the"] == 1 and one[" zqzqzq"] == len(pieces.coder(PATH).ids(" zqzqzq"))
    assert token_counts.worker_lengths("k1", PATH, None, 10) is one
    for i in range(40):
        assert one[f"x{i}"] == len(pieces.coder(PATH).ids(f"x{i}")) and len(one) <= 11
    assert token_counts.worker_lengths("k2", PATH, dict, 10) is not one


@pytest.mark.parametrize("part_chars", [5, 64, 32_768])
def test_encoding_in_parts_equals_the_library(spark, library, part_chars):
    got = {(r[0], tuple(r[1]), r[2]) for r in bpe.encode(rows(spark), part_chars=part_chars).collect()}
    want = set()
    for i, t in [*enumerate(TEXTS), (None, "null id")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    assert got == want
    assert bpe.encode(rows(spark), part_chars=part_chars).count() == len(TEXTS) + 2
    assert bpe.encode(rows(spark).limit(0), part_chars=part_chars).count() == 0


def test_joins_of_random_texts(library):
    c, r = pieces.coder(PATH), random.Random(5)
    for _ in range(400):
        alphabet = r.choice(["ab ", "aé'sl \n", "the ing", "x", "🙂a ", "0 1a!_", "abcdefghijklmnop"])
        text = "".join(r.choice(alphabet) for _ in range(r.randint(2, 400)))
        n = r.randint(2, 8)
        cuts = sorted(r.randint(0, len(text)) for _ in range(n - 1))
        parts = [pieces.Encoded.of(c, text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        whole = pieces.join_tree(c, parts)
        assert whole.ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert "".join(run[0] for run in whole.runs) == text == "".join(c.split(text))
        for run, ends, cuts, ids in whole.runs:
            assert len(run) == ends[-1] and len(ids) == cuts[-1] and len(ends) == len(cuts)


def test_unsplit_joins(library):
    c, r = pieces.coder(PATH), random.Random(6)
    for _ in range(300):
        text = "".join(r.choice(r.choice(["ab", "aeinrst", "thing", "é"])) for _ in range(r.randint(2, 3000)))
        cut = r.randint(1, len(text) - 1)
        a, b = text[:cut].encode(), text[cut:].encode()
        assert c.join_raw(c.raw(a), c.raw(b), window=1) == c.raw(a + b)
