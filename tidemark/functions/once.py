"""A value that an expression uses more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once a row, however often and in whatever branches ``use`` looks at it."""
    return F.element_at(F.transform(F.array(value), use), 1)
