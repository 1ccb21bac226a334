"""Tables: stripes, chunk groups, deletion vectors, transactions, constraints, maintenance."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stripelake.operators.cursor import Cursor
from stripelake.operators.triggers import Triggers
from stripelake.storage.table import Engine, TableError


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/lake")


def series(spark, n):
    return spark.range(n).select(F.col("id").cast("int").alias("a"), (F.col("id") * 2).cast("int").alias("b"))


def test_aggregate_goldens(spark):
    r = spark.range(3_000_001).select((F.col("id") % 16384).cast("smallint").alias("s"), F.col("id").cast("int").alias("i")).agg(F.sum("s"), F.avg("s"), F.min("s"), F.max("s"), F.sum("i"), F.avg("i"), F.max("i")).first()
    assert r[0] == 24561838944 and abs(r[1] - 8187.2769189076936974) < 1e-9 and r[2:] == (0, 16383, 4500001500000, 1500000.0, 3000000)


def test_stripes_and_vacuum(engine, spark):
    t = engine.create_as("t", series(spark, 1_000_000).coalesce(1))
    assert sorted(r["rows"] for r in t.stats().collect()) == [100_000] + [150_000] * 6
    assert sorted(r["chunk_groups"] for r in t.stats().collect()) == [10] + [15] * 6
    assert t.delete("a % 2 = 0") == 500_000
    assert t.read().agg(F.sum("a"), F.sum("b")).first() == (250000000000, 500000000000)
    assert t.vacuum() == 7
    assert sum(r["rows"] for r in t.stats().collect()) == 500_000 and t.stats().count() <= 5
    assert t.read().agg(F.sum("a"), F.sum("b")).first() == (250000000000, 500000000000)
    assert t.expire() > 0 and t.read().count() == 500_000


def test_chunk_pruning(engine, spark):
    t = engine.create_as("t", series(spark, 234_568).coalesce(1))
    assert t.prune_report("a", low=123_457) == {"chunk_groups": 24, "removed": 12}
    assert t.chunk_stats().where("column = 'a'").agg(F.sum("rows")).first()[0] == 234_568


def test_delete_and_update(engine, spark):
    t = engine.create_as("t", series(spark, 20_000))
    t.delete("a % 2 = 0")
    assert t.update({"b": "b + 1"}, "a % 3 = 0") == 3333
    assert t.read().count() == 10_000 and t.read().where("b % 2 = 1").count() == 3333
    assert t.read(masks=False).count() > 10_000
    assert t.delete("a % 2 = 0") == 0


def test_upsert(engine):
    t = engine.create("t", "k int, v string", unique=[["k"]])
    t.insert([(1, "foo")])
    new = engine.spark.createDataFrame([(1, "bar"), (2, "two")], "k int, v string")
    assert t.upsert(new, ["k"]) == (0, 1)
    assert t.upsert(new, ["k"], {"v": "s.v"}) == (2, 0)
    assert sorted(map(tuple, t.read().collect())) == [(1, "bar"), (2, "two")]
    with pytest.raises(TableError):
        t.upsert(new, ["v"])
    with pytest.raises(TableError):
        t.insert([(1, "again")])


def test_constraints(engine):
    t = engine.create("t", "k int not null, v int", checks={"positive": "v > 0"})
    t.insert([(1, 1), (2, None)])
    for bad in [(None, 1)], [(3, 0)]:
        with pytest.raises((TableError, Exception)):
            t.insert(bad)
    assert t.read().count() == 2
    with pytest.raises(TableError):
        t.add_check("small", "k < 2")


def test_conflicting_writers(engine):
    engine.create("t", "k int")
    a, b = engine.table("t"), engine.table("t")
    a.insert([(1,)])
    with pytest.raises(TableError):
        b.insert([(2,)])


def test_transactions(engine):
    t = engine.create("t", "k int")
    t.begin()
    t.insert([(1,)])
    assert engine.table("t").read().count() == 0 and t.read().count() == 1
    s = t.savepoint()
    t.insert([(2,)])
    t.rollback(s)
    t.commit()
    assert engine.table("t").read().collect() == [(1,)]


def test_schema_changes(engine):
    t = engine.create("t", "k int, v string")
    t.insert([(1, "x")])
    t.add_column("d", "int", "5")
    t.insert([(2, "y", None)])
    t.drop_column("v")
    t.add_column("v", "int")
    assert sorted(map(tuple, t.read().select("k", "d", "v").collect())) == [(1, 5, None), (2, None, None)]
    with pytest.raises(TableError):
        t.add_column("r", "double", "rand()")
    t.alter_type("k", "string")
    assert t.schema["k"].dataType.simpleString() == "string"


def test_options(engine):
    t = engine.create("t", "k int", compression="none")
    t.set_options(stripe_row_limit=5000)
    for bad in {"compression": "lzma"}, {"stripe_row_limit": 999}, {"compression_level": 20}, {"other": 1}:
        with pytest.raises(TableError):
            t.set_options(**bad)
    t.reset_options("compression")
    assert t.manifest["options"]["compression"] == "zstd" and t.manifest["options"]["stripe_row_limit"] == 5000
    heap = engine.convert("t", "heap")
    with pytest.raises(TableError):
        heap.set_options(compression="lz4")
    with pytest.raises(TableError):
        engine.convert("t", "heap")
    with pytest.raises(TableError):
        t.sample()


def test_catalog(engine, spark):
    engine.create_as("t", series(spark, 10))
    engine.rename("t", "u")
    assert engine.tables() == ["u"]
    engine.drop("u")
    assert engine.tables() == []
    with pytest.raises(TableError):
        engine.table("u")


def test_cursor(spark):
    c = Cursor(spark.range(100).select("id"), ["id"])
    assert [r["id"] for r in c.fetch(3)] == [0, 1, 2]
    assert [r["id"] for r in c.fetch(-1)] == [1]
    assert c.last()[0]["id"] == 99 and c.fetch(1) == []
    assert [r["id"] for r in c.fetch(-2)] == [99, 98]
    assert c.relative(-8)[0]["id"] == 90


def test_triggers(engine):
    t = Triggers(engine.create("t", "k int"))
    seen = []
    t.on("before", lambda: seen.append("before"))
    t.on("before_row", lambda df: df.where("k > 0"))
    t.on("after", lambda df: seen.append(df.count()))
    t.append(engine.spark.createDataFrame([(1,), (-1,), (2,)], "k int"))
    assert seen == ["before", 2]
    with pytest.raises(TableError):
        t.on("after_row", print)


def test_stream_keeps_view(engine, spark, tmp_path):
    from stripelake.streaming.matview import IncrementalView

    spark.range(10).select((F.col("id") % 3).alias("g"), "id").coalesce(1).write.parquet(f"{tmp_path}/in")
    v = IncrementalView(engine, "v", ["g"], {"n": ("count", "*"), "hi": ("max", "id")}, spark.read.parquet(f"{tmp_path}/in").schema)
    stream = spark.readStream.schema("g long, id long").parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = v.follow(stream, f"file://{tmp_path}/cp")
        q.processAllAvailable()
        q.stop()
    assert sorted(map(tuple, v.read().collect())) == [(0, 4, 9), (1, 3, 7), (2, 3, 8)]


def test_failed_batch_is_applied_by_the_next_run(engine, spark, tmp_path, monkeypatch):
    from stripelake.streaming.matview import IncrementalView

    spark.range(6).select((F.col("id") % 3).alias("g"), "id").coalesce(1).write.parquet(f"{tmp_path}/in")
    v = IncrementalView(engine, "v", ["g"], {"n": ("count", "*")}, spark.read.parquet(f"{tmp_path}/in").schema)
    stream = spark.readStream.schema("g long, id long").parquet(f"{tmp_path}/in")
    write, calls = type(v.table)._write, []

    def fails_once(self, *args, **kwargs):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("no space")
        return write(self, *args, **kwargs)

    monkeypatch.setattr(type(v.table), "_write", fails_once)
    q = v.follow(stream, f"file://{tmp_path}/cp")
    with pytest.raises(Exception, match="no space"):
        q.processAllAvailable()
    q.stop()
    assert v.read().count() == 0
    for _ in range(2):
        q = v.follow(stream, f"file://{tmp_path}/cp")
        q.processAllAvailable()
        q.stop()
    assert sorted(map(tuple, v.read().collect())) == [(0, 2), (1, 2), (2, 2)] and len(calls) == 2


def test_one_of_many_writers_wins(engine):
    from concurrent.futures import ThreadPoolExecutor

    store = engine.create("t", "k int").store
    path = store.at("t", "manifest", "99.json")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: store.create(path, str(i)), range(8)))
    assert sum(won) == 1 and store.read(path) == str(won.index(True))


def test_indexes_and_reports(engine, spark):
    t = engine.create_as("t", series(spark, 5_000).coalesce(1), chunk_group_row_limit=1000)
    for bad in (lambda: t.create_index("i", ["a"], "brin"), lambda: t.create_index("i", ["zz"]), t.cluster, lambda: t.drop_index("no"), lambda: t.upgrade(7)):
        with pytest.raises(TableError):
            bad()
    t.create_index("i", ["a"], unique=True)
    t.reindex()
    with pytest.raises(TableError):
        t.insert([(1, 1)])
    t.drop_index("i")
    t.upgrade()
    e = t.explain(["b"], "a", low=4_500)
    assert e["columns"] == ["a", "b"] and e["chunk_groups"] == 5 and e["removed"] == 4 and any("GreaterThanOrEqual" in x for x in e["pushed"])
    assert [(r["column"], r["nulls"], r["low"], r["high"]) for r in t.analyze().orderBy("column").collect()] == [("a", 0, "0", "4999"), ("b", 0, "0", "9998")]
    assert t.report()["chunks"] == {"zstd": 10}
    t.delete("a < 10")
    assert t.read_locked("a < 20").count() == 10
    engine.configure(enable_dml=False, enable_vectorization=True)
    assert t.read().count() == 5_000
    engine.configure(enable_dml=True)
    with pytest.raises(TableError):
        engine.configure(enable_magic=True)
