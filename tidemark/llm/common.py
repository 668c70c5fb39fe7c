"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(col: str, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(modulus))


def bounded_sample(df: DataFrame, keys: list[str], limit: int, *, by: str | None = None, seed: int = 11) -> tuple[DataFrame, int]:
    """Up to about ``limit`` rows of ``df`` that differ in ``keys``, and about how many such rows there are.

    Rows are chosen by a hash of the keys, so the same in every run; of rows that agree in them one stays, and copies are
    combined before the shuffle. The number of distinct rows is estimated first (a scan of the keys, within one per cent), the
    hash threshold follows from it, so repeated or null keys neither crowd the sample nor empty it: it exceeds ``limit`` by
    chance alone, by a few per cent. Up to ``limit`` distinct rows all are kept. Needs no sort.

    With ``by``, each value of that column has an equal part of the limit, one row at least: rare values are drawn as well. Of more
    than ``limit`` values the commonest are drawn.
    """
    hashed, buckets = F.xxhash64(*keys, F.lit(seed)), 1 << 30
    place = F.pmod(hashed, F.lit(buckets))
    if by is None:
        n = df.agg(F.approx_count_distinct(hashed, 0.01)).first()[0]
        some = df if n <= limit else df.filter(place < int(buckets * (limit / n)))
        return some.dropDuplicates(keys), n
    per = df.groupBy(by).agg(F.approx_count_distinct(hashed, 0.02).alias("n")).orderBy(F.desc("n"), by).limit(limit).collect()
    if not per:
        return df.limit(0), 0
    part = -(-limit // len(per))
    least = df.sparkSession.createDataFrame([(r[0], buckets if r.n <= part else max(1, int(buckets * (part / r.n)))) for r in per], f"_by {df.schema[by].dataType.simpleString()}, _most long")
    some = df.join(F.broadcast(least), F.col(by).eqNullSafe(F.col("_by"))).filter(place < F.col("_most"))
    return some.select(*df.columns).dropDuplicates(keys), sum(r.n for r in per)


def some_files(df: DataFrame, limit: int) -> DataFrame:
    """The rows of about ``limit`` of the files that ``df`` is read from, chosen by a hash of their names; the others are not opened.

    All rows, if there are no more files than that, or if ``df`` is more than a scan with filters and columns taken from it.
    """
    n = len(df._jdf.inputFiles())
    if n <= limit:
        return df
    try:
        name = df.metadataColumn("_metadata")["file_path"]
        return df.filter(F.pmod(F.xxhash64(name), F.lit(1 << 30)) < int((1 << 30) * (limit / n)))
    except AnalysisException:
        return df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder, and read from there: a lost executor costs no more than a read.

    Unlike checkpoint() it computes the last stage once, and later reads take only the columns that they need. The folder goes
    with the session.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)
