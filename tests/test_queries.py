"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

import stripelake.plans as plans
from stripelake.plans.registry import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, duck):
    got = plans.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in plans.ORACLES:
        assert rows
        return
    cur = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    assert a == b
