"""Queries over mutable tables: each builds a table from the driver's data, changes it, and reads it back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from ..storage.table import Engine
from .registry import Registry

R = Registry()
_folders: list[str] = []


def engine(spark) -> Engine:
    """An engine in a fresh folder below the cluster's shared folder, or, where none is set, below a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not _folders:
            _folders.append(tempfile.mkdtemp(prefix="stripelake-tables-"))
            atexit.register(shutil.rmtree, _folders[0], True)
        shared = "file://" + _folders[0]
    return Engine(spark, f"{shared.rstrip('/')}/stripelake-tables/{uuid.uuid4().hex}")


def orders(read):
    return read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


BASE = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM {orders}"


@R.frame("dml_insert_select", f"{BASE} UNION ALL {BASE} WHERE o_orderstatus = 'P'")
def _(read, spark):
    t = engine(spark).create_as("t", orders(read))
    t.append(t.read().where("o_orderstatus = 'P'"))  # a table can be read while it is appended to
    return t.read()


@R.frame("dml_insert_values", "SELECT * FROM (VALUES (1, 'a', 10), (2, CAST(NULL AS VARCHAR), 10), (3, 'c', 7)) AS v(i, t, d)")
def _(read, spark):
    t = engine(spark).create("t", "i int, t string, d int")
    t.set_default("d", "10")
    t.insert([(1, "a"), (2, None)], ["i", "t"])
    t.insert([(3, "c", 7)])
    return t.read()


@R.frame("dml_delete", f"{BASE} WHERE NOT (o_orderkey % 2 = 0)")
def _(read, spark):
    t = engine(spark).create_as("t", orders(read), stripe_row_limit=2000, chunk_group_row_limit=1000)
    t.delete("o_orderkey % 2 = 0")
    return t.read()


@R.frame("dml_update", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM {orders} WHERE NOT (o_orderkey % 2 = 0)")
def _(read, spark):
    t = engine(spark).create_as("t", orders(read), stripe_row_limit=2000, chunk_group_row_limit=1000)
    t.delete("o_orderkey % 2 = 0")
    t.update({"o_orderstatus": "'X'", "o_totalprice": "o_totalprice * 2"}, "o_orderkey % 3 = 0")
    return t.read()


@R.frame("dml_upsert", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM {orders} UNION ALL SELECT -1 - o_orderkey, o_custkey, 'U', o_totalprice FROM {orders} WHERE o_orderkey % 5 = 0")
def _(read, spark):
    t = engine(spark).create("t", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double", unique=[["o_orderkey"]])
    t.append(orders(read))
    changed = orders(read).where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("U"))
    t.upsert(changed.unionByName(changed.withColumn("o_orderkey", -1 - F.col("o_orderkey"))), ["o_orderkey"], {"o_orderstatus": "s.o_orderstatus"})
    return t.read()


@R.frame("dml_insert_or_nothing", f"{BASE} UNION ALL SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM {{orders}} WHERE o_orderkey % 7 = 0")
def _(read, spark):
    t = engine(spark).create("t", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double", unique=[["o_orderkey"]])
    t.append(orders(read))
    some = orders(read).where("o_orderkey % 7 = 0")
    t.upsert(some.withColumn("o_orderstatus", F.lit("U")).unionByName(some.withColumn("o_orderkey", -1 - F.col("o_orderkey"))), ["o_orderkey"])
    return t.read()


@R.frame("dml_truncate", BASE)
def _(read, spark):
    t = engine(spark).create_as("t", orders(read))
    t.truncate()
    t.append(orders(read))
    return t.read()


@R.frame("dml_returning", "SELECT o_orderkey * 10 AS k FROM {orders}")
def _(read, spark):
    t = engine(spark).create_as("t", orders(read).limit(0))
    return t.append(orders(read)).select((F.col("o_orderkey") * 10).alias("k"))


@R.frame("dml_savepoints", f"{BASE} WHERE o_orderstatus = 'F' UNION ALL {BASE} WHERE o_orderstatus = 'P'")
def _(read, spark):
    t = engine(spark).create_as("t", orders(read).where("o_orderstatus = 'F'"))
    t.begin()
    t.append(orders(read).where("o_orderstatus = 'P'"))
    s = t.savepoint()
    t.delete("o_totalprice < 100000")
    t.rollback(s)
    t.commit()
    t.begin()
    t.truncate()
    t.rollback()
    return t.engine.table("t").read()


@R.frame("dml_snapshot", f"SELECT (SELECT count(*) FROM {{orders}}) AS before, (SELECT count(*) FROM {{orders}} WHERE o_custkey >= 100) AS after")
def _(read, spark):
    t = engine(spark).create_as("t", orders(read))
    v = t.manifest["version"]
    t.delete("o_custkey < 100")
    old, new = t.engine.table("t", v).read().agg(F.count("*").alias("before")), t.read().agg(F.count("*").alias("after"))
    return old.crossJoin(new)


@R.frame("dml_fetch_by_row_id", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 1")
def _(read, spark):
    t = engine(spark).create_as("t", orders(read))
    row = t.read(row_ids=True).orderBy("o_orderkey").first()
    return t.fetch(row["_file"], row["_row"]).select("o_orderkey")


@R.frame("ddl_add_column", "SELECT o_orderkey, 7 AS extra, CAST(NULL AS VARCHAR) AS note FROM {orders} WHERE o_custkey < 50 UNION ALL SELECT o_orderkey, CAST(NULL AS INTEGER), 'new' FROM {orders} WHERE o_custkey >= 50")
def _(read, spark):
    t = engine(spark).create_as("t", read("orders").where("o_custkey < 50").select("o_orderkey"))
    t.add_column("extra", "int", "7")
    t.add_column("note", "string")
    t.append(read("orders").where("o_custkey >= 50").select("o_orderkey", F.lit(None).cast("int").alias("extra"), F.lit("new").alias("note")))
    return t.read()


@R.frame("ddl_drop_rename_column", "SELECT o_orderkey AS k, o_totalprice FROM {orders}")
def _(read, spark):
    t = engine(spark).create_as("t", orders(read))
    t.drop_column("o_custkey")
    t.drop_column("o_orderstatus")
    t.rename_column("o_orderkey", "k")
    return t.read()


@R.frame("ddl_alter_type", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS o_totalprice FROM {orders}")
def _(read, spark):
    t = engine(spark).create_as("t", read("orders").select("o_orderkey", "o_totalprice"))
    t.alter_type("o_orderkey", "string")
    t.alter_type("o_totalprice", "bigint", "floor(o_totalprice)")
    return t.read()


@R.frame("ddl_convert_roundtrip", BASE)
def _(read, spark):
    e = engine(spark)
    e.create_as("t", orders(read))
    e.convert("t", "heap")
    return e.convert("t", "columnar").read()


@R.frame("ddl_create_like", BASE)
def _(read, spark):
    e = engine(spark)
    e.create_as("t", orders(read).limit(0), compression="lz4")
    t = e.like("u", "t")
    t.append(orders(read))
    return t.read()


@R.frame("ddl_options", "SELECT * FROM (VALUES ('lz4', 2000, 1000), ('zstd', 150000, 10000)) AS v(compression, stripe, chunk)")
def _(read, spark):
    t = engine(spark).create("t", "i int")
    t.set_options(compression="lz4", stripe_row_limit=2000, chunk_group_row_limit=1000)
    a = t.manifest["options"]
    t.reset_options()
    b = t.manifest["options"]
    return spark.createDataFrame([(o["compression"], o["stripe_row_limit"], o["chunk_group_row_limit"]) for o in (a, b)], "compression string, stripe int, chunk int")


@R.frame("vacuum_preserves", f"{BASE} WHERE o_orderkey % 4 = 1")
def _(read, spark):
    t = engine(spark).create_as("t", orders(read), stripe_row_limit=1000, chunk_group_row_limit=1000)
    t.delete("o_orderkey % 4 <> 1")
    t.vacuum()
    return t.read()


@R.frame("vacuum_full_preserves", f"{BASE} WHERE o_custkey > 100")
def _(read, spark):
    t = engine(spark).create_as("t", orders(read), stripe_row_limit=1000, chunk_group_row_limit=1000)
    t.delete("o_custkey <= 100")
    t.engine.vacuum_full()
    return t.engine.table("t").read()


@R.frame("stats_stripes", "SELECT CAST(sum(1) AS BIGINT) AS n, CAST(0 AS BIGINT) AS deleted FROM {lineitem}")
def _(read, spark):
    t = engine(spark).create_as("t", read("lineitem").select("l_orderkey", "l_linenumber"), stripe_row_limit=20_000)
    return t.stats().agg(F.sum("rows").alias("n"), F.sum("deleted").alias("deleted"))


@R.frame("stats_chunks")
def _(read, spark):
    t = engine(spark).create_as("t", read("lineitem").select("l_orderkey", "l_linenumber"), stripe_row_limit=20_000)
    return t.chunk_stats().select("column", "group", "rows", "codec", "low", "high", "nulls")


@R.frame("matview_refresh", "SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_custkey >= 40 GROUP BY o_orderstatus")
def _(read, spark):
    e = engine(spark)
    t = e.create_as("t", orders(read))
    e.materialize("v", lambda: e.table("t").read().groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    t.delete("o_custkey < 40")
    return e.refresh("v").read()


@R.frame("matview_incremental", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM {orders} GROUP BY o_orderstatus")
def _(read, spark):
    from ..streaming.matview import IncrementalView

    e = engine(spark)
    v = IncrementalView(e, "v", ["o_orderstatus"], {"n": ("count", "*"), "s": ("sum", "o_custkey")}, orders(read).schema)
    for part in ("o_custkey % 2 = 0", "o_custkey % 2 = 1"):
        v.apply(orders(read).where(part))
    return v.read()


@R.frame("copy_csv_roundtrip", "SELECT c_custkey, c_name, c_acctbal FROM {customer}")
def _(read, spark):
    from ..sources.copy import copy_from, copy_to

    path = engine(spark).store.root + "/csv"
    copy_to(read("customer").select("c_custkey", "c_name", "c_acctbal"), path, delimiter="|", header=True)
    return copy_from(spark, path, "c_custkey long, c_name string, c_acctbal double", delimiter="|", header=True)


@R.frame("copy_from_lines", "SELECT * FROM (VALUES (1, 'one'), (2, CAST(NULL AS VARCHAR)), (3, 'a,b')) AS v(i, t)")
def _(read, spark):
    from ..sources.copy import copy_lines

    return copy_lines(spark, ["1,one", "2,", '3,"a,b"'], "i int, t string")


@R.frame("row_level_security", "SELECT n_name FROM {nation} WHERE n_regionkey = 1")
def _(read, spark):
    from ..operators.policy import Policy

    return Policy(read("nation").withColumn("owner", F.when(F.col("n_regionkey") == 1, F.current_user()).otherwise(F.lit("nobody else"))), "owner = current_user()").read().select("n_name")


@R.frame("scan_index_ordered", f"{BASE} WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice, o_orderkey LIMIT 20")
def _(read, spark):
    t = engine(spark).create_as("t", orders(read).orderBy("o_totalprice"), stripe_row_limit=20_000, chunk_group_row_limit=1_000)
    return t.first("o_totalprice", 20)


@R.frame("join_chunk_filter", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000")
def _(read, spark):
    t = engine(spark).create_as("t", orders(read).orderBy("o_custkey"))
    some = read("customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 9000").select("c_custkey", "c_name")
    return t.within("o_custkey", some, "c_custkey").join(some, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@R.frame("join_columnar_with_row", "SELECT c_mktsegment, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment")
def _(read, spark):
    e = engine(spark)
    columnar = e.create_as("orders", orders(read))
    row = e.create_as("customer", read("customer").select("c_custkey", "c_mktsegment"), method="heap")
    return columnar.read().join(row.read(), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@R.frame("sequence_assign", "SELECT o_orderkey, 100 + 5 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS id FROM {orders}")
def _(read, spark):
    from ..functions.sequences import Sequence

    return Sequence(100, 5).assign(orders(read).select("o_orderkey"), ["o_orderkey"], "id").select("o_orderkey", "id")


@R.frame("dml_update_returning", "SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM {orders} WHERE o_orderstatus = 'P'")
def _(read, spark):
    t = engine(spark).create_as("t", orders(read))
    return t.update_returning({"o_totalprice": "o_totalprice * 2"}, "o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")


@R.frame("dml_move_rows", f"SELECT 'kept' AS place, * FROM ({BASE} WHERE o_orderstatus <> 'F') UNION ALL SELECT 'moved', * FROM ({BASE} WHERE o_orderstatus = 'F')")
def _(read, spark):
    e = engine(spark)
    t, archive = e.create_as("t", orders(read)), e.create_as("archive", orders(read).limit(0))
    archive.append(t.delete_returning("o_orderstatus = 'F'"))
    place = lambda df, name: df.select(F.lit(name).alias("place"), "*")
    return place(t.read(), "kept").unionByName(place(archive.read(), "moved"))


@R.frame("trigger_transition_tables", "SELECT 'update' AS op, count(*) AS n, CAST(round(sum(o_totalprice)) AS BIGINT) AS gained FROM {orders} WHERE o_orderstatus = 'P' UNION ALL SELECT 'delete', count(*), CAST(round(-sum(o_totalprice)) AS BIGINT) FROM {orders} WHERE o_orderstatus = 'F'")
def _(read, spark):
    from ..operators.triggers import Triggers

    e = engine(spark)
    t, log = Triggers(e.create_as("t", orders(read))), e.create("log", "op string, n long, gained long")

    def audit(op, old, new=None):
        signed = old.select((-F.col("o_totalprice")).alias("x"), F.lit(1).alias("one"))
        if new is not None:
            signed = signed.unionByName(new.select(F.col("o_totalprice").alias("x"), F.lit(0).alias("one")))
        log.append(signed.agg(F.lit(op).alias("op"), F.sum("one").alias("n"), F.round(F.sum("x")).cast("long").alias("gained")))

    t.on("after", lambda old, new: audit("update", old, new), of="update")
    t.on("after", lambda old: audit("delete", old), of="delete")
    t.update({"o_totalprice": "o_totalprice * 2"}, "o_orderstatus = 'P'")
    t.delete("o_orderstatus = 'F'")
    return log.read()


@R.frame("policy_on_table", f"SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS o_totalprice FROM {{orders}}")
def _(read, spark):
    t = engine(spark).create_as("t", orders(read))
    t.add_policy("open_ones", "o_orderstatus = 'P' and current_user() is not null")
    t.update({"o_totalprice": "0"})  # reaches visible rows alone
    return t.read(policies=False)
