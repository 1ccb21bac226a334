"""Joins and aggregates on keys of which a few hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(big: DataFrame, small: DataFrame, key: str, *, salts: int = 16, how: str = "inner") -> DataFrame:
    """Joins on ``key`` with each key of ``big`` dealt to ``salts`` partitions; rows of ``small`` are repeated so often.

    ``how`` is inner, left, left_semi or left_anti, where a repeated row of ``small`` changes nothing.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}")
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def two_step(df: DataFrame, keys: list[str], first: dict[str, Column], then: dict[str, Column], *, salts: int = 16) -> DataFrame:
    """Aggregates that cannot be combined before the shuffle: ``first`` by key and salt, then ``then`` over its columns by key."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)).cast("int")
    part = df.groupBy(*keys, salt.alias("_salt")).agg(*[c.alias(n) for n, c in first.items()])
    return part.groupBy(*keys).agg(*[c.alias(n) for n, c in then.items()])
