"""Orders over expressions, which are evaluated once a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """An expression to sort by; ``reverse`` turns its order, nulls included."""

    column: Column
    reverse: bool = False


def keyed(df: DataFrame, order: tuple[Key | Column | str, ...]) -> tuple[DataFrame, list[Column | str]]:
    """``df`` with the keys of ``order`` as columns, and the order over them.

    A sort evaluates what it sorts by anew at each comparison, so an expression over a line costs n log n times what it does here.
    """
    keys, told = {}, []
    for i, k in enumerate(order):
        if isinstance(k, Key):
            keys[f"_order{i}"] = k.column
            k = F.col(f"_order{i}").desc_nulls_last() if k.reverse else F.col(f"_order{i}").asc_nulls_first()
        told.append(k)
    return df.withColumns(keys) if keys else df, told
