"""Distances between arrays of numbers, and exact top-k, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column | str, b: Column | str) -> Column:
    """Null when a vector or a component is null; the shorter vector is missing its last components, so null too."""
    return F.sqrt(_sum(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))))


def inner_product(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - inner_product(a, b) / F.sqrt(inner_product(a, a) * inner_product(b, b))


def top_k(df: DataFrame, distance: str, tie: str, k: int) -> DataFrame:
    """The k nearest rows: every task keeps k, the driver merges them."""
    return df.where(F.col(distance).isNotNull()).orderBy(distance, tie).limit(k)
