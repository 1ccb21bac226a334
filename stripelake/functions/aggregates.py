"""User-defined aggregates made of partial, merge and final steps that Spark runs by itself, and exact integer aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def user_aggregate(parts: dict[str, Callable[[Column], Column]], final: Callable[..., Column]) -> Callable[[Column | str], Column]:
    """An aggregate from named built-in ones and a function of their results.

    The built-in parts are combined within tasks before the shuffle, so no group is gathered in one call.
    """

    def apply(column: Column | str) -> Column:
        c = F.col(column) if isinstance(column, str) else column
        return final(**{name: part(c) for name, part in parts.items()})

    return apply


root_mean_square = user_aggregate({"squares": lambda x: F.sum(x * x), "n": F.count}, lambda squares, n: F.sqrt(squares / n))


def exact_sum(column: Column | str) -> Column:
    """The sum of integers as a decimal of 38 digits, which 64 bits cannot overflow."""
    return F.sum((F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)"))


def exact_avg(column: Column | str, digits: int = 16) -> Column:
    """The average of integers as a decimal with ``digits`` places, rounded half up."""
    c = F.col(column) if isinstance(column, str) else column
    return (exact_sum(c).cast("decimal(22,0)") / F.count(c)).cast(f"decimal(38,{digits})")
