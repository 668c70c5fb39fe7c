"""What the two vector searches share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def finite(col: str) -> Column:
    """Not null, not empty, and without a null or non-finite component."""
    v = F.col(col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def commonest_size(df: DataFrame, col: str) -> int:
    """The commonest number of components; 0 without rows. Other rows cannot be compared and take no part."""
    row = df.groupBy(F.size(col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row.d if row else 0


def matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """A list column as float64 rows."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    return np.concatenate(flat).astype(np.float64).reshape(-1, d) if flat else np.zeros((0, d))


def distinct_best(ids: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Positions of the highest score of each id, in order of score, highest first; ties go to the smaller id."""
    order = np.lexsort((ids, -score))
    first = np.unique(ids[order], return_index=True)[1]
    return order[np.sort(first)]


def best(found: DataFrame, k: int, score_order: Column) -> DataFrame:
    """The k best rows (query_id, rank, vec_id, score) of each query; ties go to the smaller vec_id."""
    order = W.partitionBy("query_id").orderBy(score_order, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
