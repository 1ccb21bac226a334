"""Text sources, functions on ranges, geometry and dates."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from stripelake.functions import dates, enums, geometry, ranges
from stripelake.operators.skew import salted_join, two_step
from stripelake.sources.copy import copy_from, copy_lines, copy_to
from stripelake.sources.http import HttpRequest


def test_copy(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, None, 2.5)], "i int, t string, x double")
    copy_to(df, f"{tmp_path}/c", delimiter=";")
    assert sorted(map(tuple, copy_from(spark, f"{tmp_path}/c", "i int, t string, x double", delimiter=";").collect())) == [(1, "a,b", None), (2, None, 2.5)]
    copy_to(df.select("x", "i"), f"{tmp_path}/d")
    got = copy_from(spark, f"{tmp_path}/d", "i int, t string, x double", columns=["x", "i"])
    assert sorted(map(tuple, got.collect())) == [(1, None, None), (2, None, 2.5)]
    with pytest.raises(Exception, match="(?i)malformed|bad|parse"):
        copy_lines(spark, ["x"], "i int").collect()


def test_http_without_a_server(spark):
    spark.udtf.register("http_request", HttpRequest)
    row = spark.sql("SELECT * FROM http_request('PUT', 'http://127.0.0.1:9/x', 'body', 'text/plain')").first()
    assert row["status"] == 0 and row["content"]


def test_ranges(spark):
    make = lambda lo, hi, b="[)": ranges.make(F.lit(lo).cast("double"), F.lit(hi).cast("double"), b)
    checks = {
        "a": (ranges.contains(make(1.1, 2.2, "()"), F.lit(1.1)), False),
        "b": (ranges.contains(make(1.1, 2.2), F.lit(1.1)), True),
        "c": (ranges.contains(make(None, 2.2), F.lit(-1e9)), True),
        "d": (ranges.overlaps(make(1, 2), make(2, 3)), False),
        "e": (ranges.overlaps(make(1, 2, "[]"), make(2, 3)), True),
        "f": (ranges.is_empty(make(2, 2)), True),
        "g": (ranges.equal(make(2, 2), make(5, 5)), True),
        "h": (ranges.equal(make(1, 2), make(1, 2, "[]")), False),
        "i": (ranges.sort_key(make(2, 2)) < ranges.sort_key(make(None, 1)), True),
        "j": (ranges.sort_key(make(1, 2)) < ranges.sort_key(make(1, None)), True),
    }
    row = spark.range(1).select(*[c.alias(n) for n, (c, _) in checks.items()]).first()
    assert {n: row[n] for n in checks} == {n: w for n, (_, w) in checks.items()}


def test_geometry_dates_enums(spark):
    p = lambda x, y: geometry.point(F.lit(x), F.lit(y))
    row = spark.range(1).select(
        geometry.distance(p(0, 0), p(3, 4)).alias("d"),
        geometry.boxes_overlap(geometry.box(p(0, 0), p(2, 2)), geometry.box(p(3, 1), p(1, 3))).alias("b"),
        geometry.area(geometry.circle(F.lit(0), F.lit(0), F.lit(2))).alias("a"),
        dates.is_finite(dates.parse(F.lit("infinity"))).alias("i"),
        dates.is_finite(dates.parse(F.lit("2020-02-29"))).alias("f"),
        enums.rank(F.lit("b"), ["c", "b"]).alias("r"),
        enums.rank(F.lit("z"), ["c", "b"]).alias("z"),
    ).first()
    assert row["d"] == 5 and row["b"] and row["a"] == pytest.approx(4 * math.pi) and not row["i"] and row["f"] and row["r"] == 2 and row["z"] is None


def test_skew(spark):
    big = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    small = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "k int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert salted_join(big, small, "k", how=how).count() == big.join(small, "k", how).count()
    with pytest.raises(ValueError, match="cannot"):
        salted_join(big, small, "k", how="full")
    got = two_step(big, ["k"], {"n": F.count("*")}, {"n": F.sum("n")}).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(0, 666), (1, 334)]
