"""Random predicates and aggregates, Spark against DuckDB, with scan features on and off."""

from __future__ import annotations

import random

import duckdb
import pytest

PATH = "/root/testdata/sf0.001/lineitem.parquet"
NUMBERS = {"l_orderkey": (0, 1500), "l_partkey": (0, 250), "l_suppkey": (0, 15), "l_linenumber": (1, 7), "l_quantity": (1, 50), "l_discount": (0, 0.1)}


def predicate(rng, depth=0):
    kind = rng.random()
    if depth < 3 and kind < 0.45:
        return f"({predicate(rng, depth + 1)} {rng.choice(['AND', 'OR'])} {predicate(rng, depth + 1)})"
    if depth < 3 and kind < 0.55:
        return f"NOT ({predicate(rng, depth + 1)})"
    c = rng.choice(sorted(NUMBERS))
    low, high = NUMBERS[c]
    value = lambda: round(rng.uniform(low, high), 2) if isinstance(high, float) else rng.randint(low, high)
    if kind < 0.65:
        return f"{c} BETWEEN {value()} AND {value()}"
    if kind < 0.72:
        return f"{c} IN ({value()}, {value()}, {value()})"
    if kind < 0.79:
        return f"CASE WHEN l_linenumber > 4 THEN {c} END {rng.choice(['IS NULL', 'IS NOT NULL', f'> {value()}'])}"
    if kind < 0.86:
        return f"{value()} {rng.choice(['<', '<=', '>', '>=', '=', '<>'])} {c}"
    if kind < 0.93:
        return f"l_returnflag {rng.choice(['=', '<>', '<', '>='])} '{rng.choice('ANR')}'"
    return f"{c} {rng.choice(['<', '<=', '>', '>=', '=', '<>'])} {value()}"


@pytest.mark.parametrize("seed", range(25))
def test_predicates(spark, seed):
    rng = random.Random(seed)
    where = predicate(rng)
    text = f"SELECT count(*), sum(CAST(l_orderkey AS BIGINT)), min(l_partkey), max(l_suppkey), count(DISTINCT l_linenumber), count(*) FILTER (WHERE {predicate(rng)}) FROM {{t}} WHERE {where}"
    want = duckdb.connect().execute(text.format(t=f"'{PATH}'")).fetchone()
    setting = "spark.sql.parquet.filterPushdown"
    for pushdown in ("true", "false"):
        spark.conf.set(setting, pushdown)
        try:
            got = tuple(spark.sql(text, t=spark.read.parquet(PATH)).first())
        finally:
            spark.conf.unset(setting)
        assert got == tuple(want), where


def test_scan_reads_what_it_needs(spark):
    df = spark.sql("SELECT l_partkey FROM {t} WHERE l_orderkey > 1000 AND l_quantity < 5", t=spark.read.parquet(PATH))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(l_orderkey,1000)" in plan and "LessThan(l_quantity,5.0)" in plan
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert sorted(x.split(":")[0] for x in schema.split(",")) == ["l_orderkey", "l_partkey", "l_quantity"]
