"""Numbers of rows in an order, over tables of several range partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stripelake.functions.sequences import Sequence
from stripelake.operators.cursor import Cursor

N = 1_000_000


def mixed(spark):
    return spark.range(0, N, 1, 8).select(((F.col("id") * 7919) % N).alias("k"))


def test_sequence_over_several_partitions(spark):
    s = Sequence(100, 5)
    got = s.assign(mixed(spark), ["k"], "id")
    for _ in range(2):  # each run of the plan gives the same numbers
        assert got.where(F.col("id") != 100 + 5 * F.col("k")).count() == 0
    assert got.count() == N and s.nextval() == 100 + 5 * N
    assert s.assign(mixed(spark).limit(0), ["k"], "id").count() == 0 and s.currval() == 100 + 5 * N


def test_cursor_over_several_partitions(spark):
    c = Cursor(mixed(spark).withColumn("nothing", F.lit(None)), ["k"])
    assert c.rows.columns == ["k", "nothing", "position"]
    assert c.rows.where(F.col("position") != F.col("k") + 1).count() == 0
    assert [r["k"] for r in c.absolute(500_000)] == [499_999] and c.last()[0]["k"] == N - 1
    assert Cursor(mixed(spark), [F.desc("k")]).first()[0]["k"] == N - 1
