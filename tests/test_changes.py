"""Rows returned by changes, transition tables, policies of tables, unique keys of appended rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stripelake.functions.formats import zero_padded
from stripelake.operators.triggers import Triggers
from stripelake.storage.table import Engine, TableError


@pytest.fixture()
def table(spark, tmp_path):
    t = Engine(spark, f"file://{tmp_path}/lake").create("t", "k int, v string", unique=[["k"]])
    t.insert([(1, "a"), (2, "b"), (3, None)])
    return t


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_returning(table):
    assert rows(table.update_returning({"v": "'x'"}, "k < 3")) == [(1, "x"), (2, "x")]
    assert rows(table.delete_returning("k = 2")) == [(2, "x")]
    assert rows(table.delete_returning("k = 99")) == [] and rows(table.update_returning({"v": "'y'"}, "k = 99")) == []
    assert rows(table.delete_returning("v is null")) == [(3, None)]
    assert rows(table.read()) == [(1, "x")]


def test_returning_of_all_rows_and_in_a_transaction(table):
    table.begin()
    assert len(rows(table.delete_returning("true"))) == 3
    table.rollback()
    assert table.read().count() == 3


def test_transition_tables(table):
    seen = []
    t = Triggers(table)
    t.on("before", lambda: seen.append("before"), of="update")
    t.on("before_row", lambda df: df.withColumn("v", F.upper("v")), of="update")
    t.on("after", lambda old, new: seen.append((rows(old), rows(new))), of="update")
    t.on("after", lambda old: seen.append(rows(old)), of="delete")
    assert t.update({"v": "concat(v, 'z')"}, "k = 1") == 1
    assert t.delete("k = 2") == 1
    assert seen == ["before", ([(1, "a")], [(1, "AZ")]), [(2, "b")]]
    for event, of in (("before_row", "delete"), ("after", "truncate"), ("after_row", "insert")):
        with pytest.raises(TableError):
            t.on(event, print, of=of)


def test_policies(table):
    table.add_policy("low", "k < 2")
    assert rows(table.read()) == [(1, "a")]
    table.add_policy("none", "v = 'b'")
    assert rows(table.read()) == [(1, "a"), (2, "b")]  # a null condition hides
    assert table.delete("true") == 2 and rows(table.read(policies=False)) == [(3, None)]
    with pytest.raises(TableError, match="policies"):
        table.insert([(9, "c")])
    with pytest.raises(TableError, match="hides"):
        table.upsert(table.spark.createDataFrame([(3, "b")], "k int, v string"), ["k"], {"v": "s.v"})
    table.insert([(9, "b")])
    with pytest.raises(TableError, match="policies"):
        table.update({"v": "'c'"}, "k = 9")
    assert rows(table.engine.convert("t", "heap").read()) == [(9, "b")]
    table = table.engine.table("t")
    table.drop_policy("none")
    table.drop_policy("low")
    assert rows(table.read()) == [(3, None), (9, "b")]
    with pytest.raises(TableError):
        table.drop_policy("low")


def test_unique_keys_of_new_rows(table):
    for bad in ([(2, "again")], [(7, "a"), (7, "b")], [(-5, "a"), (50, "b"), (1, "c")]):
        with pytest.raises(TableError, match="duplicate key"):
            table.insert(bad)
    table.insert([(None, "a"), (None, "b")])
    table.insert([(None, "c")])
    table.delete("k = 2")
    table.insert([(2, "back")])
    assert table.update({"k": "k + 10"}, "k = 3") == 1
    with pytest.raises(TableError, match="duplicate key"):
        table.update({"k": "2"}, "k = 1")
    assert table.read().count() == 6


def test_zero_padded(spark):
    got = spark.sql("SELECT * FROM VALUES (5), (-5), (999), (1000), (-1000), (0), (NULL) AS t(x)").select(zero_padded("x", 3)).collect()
    assert [r[0] for r in got] == ["005", "-005", "999", "###", "-###", "000", None]
