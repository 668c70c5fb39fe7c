"""A training corpus from ``documents``: language, quality, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all but the last return the columns
of ``documents``. Between stages, rows are written as Parquet in the shared checkpoint folder and read again, so a lost
executor costs one stage at most; a stage's folder goes when the next one's is written, the last with the session.

Null and empty texts have no language and go in the first stage, so no later one meets them; each stage called by itself
treats them as its operator says. Very long texts are read whole. Repeated rows of one id are one document to
near-dedup: they stay or go together, and the mixture draws each by itself; rows with a null id link with nothing there and stay. An empty table gives an empty one in every stage, and further columns are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, minhash, mixing, quality
from tidemark.llm.common import id_remainder, table
from tidemark.llm.queries import bpe_digests


def held(docs: DataFrame) -> DataFrame:
    """Id and text, and the whole row beside them, so that no column of the row meets one that an operator adds."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows and is sure of; the rest go."""
    model = langid.fit(docs.filter(F.coalesce(id_remainder("doc_id", 4) != 2, F.lit(False))))
    return langid.predict(held(docs), model).filter(~F.col("rejected")).select("row.*")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for quality; the rest go."""
    labels = table(spark, sf_dir, "labels").filter(F.coalesce(id_remainder("doc_id", 3) != 1, F.lit(False)))
    return quality.score(held(docs), quality.fit(docs.select("doc_id", "text"), labels)).filter("predicted = 1").select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked from a similarity of 0.8 on."""
    return minhash.keep_one(docs, per_cent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each copy that it takes of a document, with the words taken."""
    mixed = mixing.mixed_texts(docs, weights=(5, 2, 1), share=1.5, most=2.0)
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each row."""
    return bpe_digests(bpe.encode(docs))


STAGES = [("language ID", language), ("quality classifier", good), ("MinHash near-dedup", distinct), ("mixing sources", mixture), ("BPE encoding", tokens)]

#: SQL can express neither the classifiers nor the draws; tests/llm/test_pipeline.py holds near-dedup against brute force and checks the others.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    folder = f"{base.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        if i:
            delete(spark, f"{folder}/{i - 1}")
        docs = spark.read.parquet(f"{folder}/{i}")
    # the last stage reads the folder that is left when its rows are asked for; it goes with the session
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def delete(spark: SparkSession, folder: str) -> None:
    """Removes a folder of this run, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
