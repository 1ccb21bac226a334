"""Joins that leave rows without a partner where they are.

The keys of the smaller side set bits in a filter of fixed size, which is broadcast.  Rows whose bit is not set have no
partner and are not shuffled; a full filter lets more rows pass, none is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter, in 32768-bit rows: its size, 4 MB, does not grow with the data.
FILTER_ROWS = 1024
ROW_BITS = 32768


def _place(key: Column, rows: int) -> tuple[Column, Column]:
    bit = F.pmod(key, F.lit(rows * ROW_BITS))
    return F.floor(bit / ROW_BITS).cast("int"), F.pmod(bit, F.lit(ROW_BITS))


def _bits(keys: DataFrame, key: str, rows: int) -> DataFrame:
    row, at = _place(F.col(key), rows)
    return keys.select(row.alias("filter_row"), at.alias("at")).groupBy("filter_row").agg(F.expr("bitmap_construct_agg(at)").alias("filter_bits"))


def touched(rows: DataFrame, key: str, keys: DataFrame, keys_key: str | None = None) -> DataFrame:
    """``rows`` with ``touched``: true for every row whose key, a well-mixed hash, is among ``keys``, and for few others."""
    row, at = _place(F.col(key), FILTER_ROWS)
    byte = F.ascii(F.decode(F.substring("filter_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    set_ = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
    out = rows.withColumn("filter_row", row).join(F.broadcast(_bits(keys, keys_key or key, FILTER_ROWS)), "filter_row", "left")
    return out.withColumn("touched", F.coalesce(set_, F.lit(False))).drop("filter_row", "filter_bits")


def left_join(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of ``found``, null without a partner; the first of ``on`` is a well-mixed hash.  No key is null."""
    mine = touched(rows, on[0], found)
    apart = mine.where("touched").drop("touched").join(found, on, "left").select(*rows.columns, *[c for c in found.columns if c not in on])
    rest = mine.where("not touched").drop("touched")
    for f in found.schema:
        if f.name not in on:
            rest = rest.withColumn(f.name, F.lit(None).cast(f.dataType))
    return rest.unionByName(apart)


def packed(keys: DataFrame, key: str, rows: int = FILTER_ROWS) -> np.ndarray:
    """The filter as bytes for tasks in Python: bit k % 8 of byte k // 8 for k = key modulo rows * ROW_BITS."""
    out = np.zeros(rows * ROW_BITS // 8, dtype=np.uint8)
    for r in _bits(keys, key, rows).collect():  # ``rows`` rows of 4 kB at most
        at = r["filter_row"] * ROW_BITS // 8
        out[at : at + ROW_BITS // 8] = np.frombuffer(bytes(r["filter_bits"]), dtype=np.uint8)
    return out


def passes(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which signed keys have their bit set in a packed filter."""
    bit = keys % np.int64(len(filter_) * 8)
    return (filter_[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


def _dealt(rows: DataFrame, keys: DataFrame, by: str) -> tuple[DataFrame, DataFrame, str]:
    """The rows under neutral column names with ``touched``, the distinct keys, and the neutral name of ``by``."""
    mine = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    name = f"c{rows.columns.index(by)}"
    named = keys.select(F.col(by).alias(name)).distinct().withColumn("filter_key", F.xxhash64(name))
    return touched(mine.withColumn("filter_key", F.xxhash64(name)), "filter_key", named).drop("filter_key"), named.select(name), name


def semi_join(rows: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """The rows whose ``by`` is among ``keys``; only rows that may be are shuffled."""
    mine, named, name = _dealt(rows, keys, by)
    out = mine.where("touched").drop("touched").join(named, name, "left_semi")
    return out.select(*[c for c in mine.columns if c != "touched"]).toDF(*rows.columns)


def anti_join(rows: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """The rows whose ``by`` is not among ``keys``; a null is among none.  Only rows that may be are shuffled."""
    mine, named, name = _dealt(rows, keys, by)
    rest, apart = mine.where("not touched").drop("touched"), mine.where("touched").drop("touched").join(named, name, "left_anti")
    return rest.unionByName(apart.select(*rest.columns)).toDF(*rows.columns)
