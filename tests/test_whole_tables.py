"""Queries over whole tables at a larger scale."""

import duckdb
import pytest

import stripelake.plans as plans
from stripelake.plans.registry import TABLES

from .test_queries import plain

SF = "/root/testdata/sf0.01"
#: Name, and the rows of DuckDB that must be among the results.
WHOLE = {
    "scalar_arithmetic": "SELECT count(*) FROM lineitem",
    "scalar_epoch": "SELECT count(*) FROM events",
    "join_cross": "SELECT count(*) FROM region, nation",
    "join_lateral_aggregate": "SELECT count(*) FROM customer",
    "sort_nulls_last": "SELECT count(*) FROM lineitem",
    "join_theta_and_equal": None,
    "set_except_all": None,
    "set_intersect_all": None,
}


@pytest.mark.parametrize("name", WHOLE)
def test_whole(name, spark):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(plans.ORACLES[name])
    names, want = [d[0] for d in cur.description], cur.fetchall()
    got = plans.QUERIES[name](spark, SF)
    assert got.columns == names
    rows = [tuple(map(plain, r)) for r in got.collect()]
    want = [tuple(map(plain, r)) for r in want]
    assert (rows == want) if name == "sort_nulls_last" else (sorted(rows, key=repr) == sorted(want, key=repr))
    if WHOLE[name]:
        assert len(rows) == con.execute(WHOLE[name]).fetchone()[0]
