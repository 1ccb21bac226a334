"""Tables of many stripes: what the driver lists, sends and holds, and rows by way of it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stripelake.storage.table import NAMED, SPAN, Engine


@pytest.fixture()
def table(spark, tmp_path):
    t = Engine(spark, f"file://{tmp_path}/lake").create_as("t", spark.range(0, 80_000, 1, 2).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")), stripe_row_limit=2000, chunk_group_row_limit=1000)
    assert len(t.manifest["files"]) == 40 > NAMED
    return t


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def numbers(df):
    return sorted(r["k"] for r in df.collect())


def test_files_are_not_looked_up_by_jobs(spark, table):
    table.delete("k % 2 = 0")
    spark.sparkContext.setJobGroup("listing", "")
    try:
        table.read()
        assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup("listing"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_deleted_rows_are_sent_as_bits(table):
    assert table.delete("k % 2 = 0") == 40_000
    assert table.manifest["spans"] == 40 * -(-2000 // SPAN)
    assert "bit_or" in plan(table.read()).split("BroadcastExchange")[1]
    assert table.delete("k % 3 = 0") == 13_333 and table.delete("k % 2 = 0") == 0
    assert numbers(table.read()) == [k for k in range(80_000) if k % 2 and k % 3]


def test_beyond_the_limit_both_sides_are_shuffled(table):
    table.delete("k % 5 <> 0 or k = 0")
    table.manifest["spans"] = None  # as a table of an earlier release
    assert "BroadcastHashJoin" not in plan(table.read())
    assert numbers(table.read()) == list(range(5, 80_000, 5))
    table.delete("k % 10 = 0")
    assert table.manifest["spans"] is None and numbers(table.read()) == list(range(5, 80_000, 10))


@pytest.mark.parametrize("gone", [2000, 4000, 70_000])
def test_files_that_left_are_not_read(table, gone):
    before = table.manifest
    assert numbers(table.delete_returning(f"k < {gone} or k = 77777")) == [*range(gone), 77777]
    assert len(table.manifest["files"]) == 40 - gone // 2000
    assert numbers(table.read()) == [k for k in range(gone, 80_000) if k != 77777]
    assert numbers(table._read(before)) == list(range(80_000))
    assert numbers(table._read(table.manifest, masks=False)) == list(range(gone, 80_000))
    assert table.vacuum() >= 0 and numbers(table.read()) == [k for k in range(gone, 80_000) if k != 77777]


def test_updates_and_upserts_of_many_stripes(spark, table):
    table.delete("k % 2 = 0")
    assert table.update({"v": "-1"}, "k % 3 = 0") == 13_333
    table.add_unique(["k"])
    assert table.upsert(spark.range(1, 80_002, 80_000).select(F.col("id").alias("k"), F.lit(-2).cast("long").alias("v")), ["k"], {"v": "s.v"}) == (1, 1)
    want = {k: -1 if k % 3 == 0 else k % 7 for k in range(1, 80_000, 2)} | {1: -2, 80_001: -2}
    assert {r["k"]: r["v"] for r in table.read().collect()} == want


def test_update_starts_no_task_a_stripe(spark, table):
    table.delete("k % 2 = 0")
    spark.sparkContext.setJobGroup("updating", "")
    try:
        assert table.update({"v": "v + 10"}, "k % 3 = 0") == 13_333
        table.read().count()
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("updating") for s in tracker.getJobInfo(j).stageIds]
        assert stages and max(s.numTasks for s in stages if s) < 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_upsert_deals_keys_by_rows_and_never_broadcasts_them(spark, tmp_path, monkeypatch):
    from stripelake.storage import table as module

    t = Engine(spark, f"file://{tmp_path}/lake").create("t", "k long, v string", unique=[["k"]])
    t.append(spark.range(9_000).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    monkeypatch.setattr(module, "MEET", 1000)
    write, plans = module.Table._write, []
    monkeypatch.setattr(module.Table, "_write", lambda self, df, *a, **k: (plans.append(plan(df)), write(self, df, *a, **k))[1])
    new = spark.range(8_000, 10_000).select(F.col("id").cast("int").alias("k"), F.lit("new").alias("v"))
    assert t.upsert(new, ["k"], {"v": "concat(t.v, s.v)"}) == (1000, 1000)
    assert t.upsert(new, ["k"]) == (0, 0)
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans[:1]) and len(plans) == 2
    assert "SortMergeJoin" in plans[1] and ", 11), REPARTITION_BY_NUM" in plans[0]
    want = [(k, "old" if k < 8_000 else "oldnew" if k < 9_000 else "new") for k in range(10_000)]
    assert sorted(map(tuple, t.read().collect())) == want
