"""Enumerations: text with a declared order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank(c: Column | str, labels: list[str]) -> Column:
    """The place of a label among ``labels``, from 1; null for others."""
    return F.nullif(F.array_position(F.lit(labels), F.col(c) if isinstance(c, str) else c), F.lit(0))
