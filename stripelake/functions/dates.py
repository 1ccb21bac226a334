"""Infinite dates, which Spark lacks: two sentinels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIVE_INFINITY = "9999-12-31"
NEGATIVE_INFINITY = "0001-01-01"


def infinity(positive: bool = True) -> Column:
    return F.lit(POSITIVE_INFINITY if positive else NEGATIVE_INFINITY).cast("date")


def is_finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (c < infinity()) & (c > infinity(False))


def parse(c: Column | str) -> Column:
    """A date from text, also ``infinity`` and ``-infinity``."""
    c = F.trim(F.lower(F.col(c) if isinstance(c, str) else c))
    return F.when(c == "infinity", infinity()).when(c == "-infinity", infinity(False)).otherwise(F.try_to_date(c))
