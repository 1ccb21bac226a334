"""Sequences: numbers that are handed out once, to single calls and to whole DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cursor import numbered


class Sequence:
    """Numbers from ``start`` in steps of ``increment``."""

    def __init__(self, start: int = 1, increment: int = 1):
        if not increment:
            raise ValueError("the increment must not be 0")
        self.increment, self.last = increment, start - increment

    def nextval(self) -> int:
        self.last += self.increment
        return self.last

    def currval(self) -> int:
        return self.last

    def setval(self, value: int) -> int:
        self.last = value
        return value

    def assign(self, df: DataFrame, order: list, name: str) -> DataFrame:
        """``df`` with the next numbers in column ``name``, in the given order, without gathering the rows."""
        rows, n = numbered(df, order)
        first = self.last
        self.last += n * self.increment
        return rows.withColumn(name, F.lit(first) + F.col("position") * self.increment).drop("position")
