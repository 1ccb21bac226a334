"""Scans, projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import Registry
from .storage import engine

R = Registry()

R.sql("scan_projection", "SELECT l_orderkey, l_linenumber, l_returnflag FROM {lineitem}")
R.sql("scan_computed_projection", "SELECT l_orderkey * 1 AS k1, l_linenumber * 2 AS n2, l_quantity + l_tax AS qt FROM {lineitem} WHERE l_linenumber <= 2")
R.sql("scan_count_star", "SELECT count(*) AS n FROM {lineitem}")
R.sql("scan_count_filtered", "SELECT count(*) AS n FROM {lineitem} WHERE l_quantity < 10")
R.sql("scan_values", "WITH s AS (SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, CAST(NULL AS STRING))) AS v(i, t)) SELECT i, t FROM s WHERE i > 1", "WITH s AS (SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, CAST(NULL AS VARCHAR))) AS v(i, t)) SELECT i, t FROM s WHERE i > 1")
R.sql("scan_generate_series", "SELECT id AS g, id % 7 AS m FROM range(0, 1001, 5)", "SELECT range AS g, range % 7 AS m FROM range(0, 1001, 5)")
R.sql("scan_series_in_select", "SELECT r_regionkey, explode(sequence(1, r_regionkey + 1)) AS g FROM {region}", "SELECT r_regionkey, CAST(unnest(generate_series(1, r_regionkey + 1)) AS INTEGER) AS g FROM {region}")
R.sql("scan_whole_row_count", "SELECT count(struct(*)) AS n FROM {nation}", "SELECT count(*) AS n FROM {nation}")
R.sql("scan_whole_row_json", "SELECT to_json(struct(n_nationkey, n_name)) AS j FROM {nation}", "SELECT CAST(to_json({{'n_nationkey': n_nationkey, 'n_name': n_name}}) AS VARCHAR) AS j FROM {nation}".replace("{{", "{").replace("}}", "}"))
R.sql("scan_row_equality", "SELECT n_name FROM {nation} WHERE struct(n_nationkey, n_regionkey) = struct(3, 1) OR struct(n_nationkey, n_regionkey) = struct(5, 0)", "SELECT n_name FROM {nation} WHERE (n_nationkey, n_regionkey) = (3, 1) OR (n_nationkey, n_regionkey) = (5, 0)")
R.sql("scan_union_of_children", "SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderdate < TIMESTAMP_NTZ '1996-01-01' UNION ALL SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderdate >= TIMESTAMP_NTZ '1996-01-01'", "SELECT o_orderkey, o_orderdate FROM {orders}")
R.sql("scan_from_json_strings", "SELECT event_id, get_json_object(props, '$.k') AS k FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM {events}")


@R.frame("scan_without_pushdown", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey BETWEEN 100 AND 900")
def _(read, spark):
    # the same plan with the filter above the scan only: the rows must not depend on pruning
    return read("lineitem").withColumn("k", F.col("l_orderkey") + 0).where("k between 100 and 900").select("l_orderkey", "l_partkey")


@R.frame("scan_partition_pruned", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders WHERE year(o_orderdate) = 1995")
def _(read, spark):
    path = f"{engine(spark).store.root}/orders-by-year"
    read("orders").select("o_orderkey", F.year("o_orderdate").alias("y")).repartition("y").write.partitionBy("y").parquet(path)
    return spark.read.schema("o_orderkey long, y int").parquet(path).where("y = 1995")  # one of the folders


@R.frame("scan_inheritance", "SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(read, spark):
    parent = read("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    child = read("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), "s_acctbal")
    return parent.unionByName(child, allowMissingColumns=True).select("key", "name")


@R.frame("scan_cursor", "SELECT o_orderkey, pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos FROM orders) WHERE pos BETWEEN 11 AND 20")
def _(read, spark):
    from ..operators.cursor import Cursor

    return Cursor(read("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).move(10).fetch_frame(10).select("o_orderkey", F.col("position").alias("pos"))


R.sql("filter_between_timestamps", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM {lineitem} WHERE l_shipdate BETWEEN TIMESTAMP_NTZ '1995-01-01' AND TIMESTAMP_NTZ '1996-01-01'", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM {lineitem} WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01'")
R.sql("filter_constant_left", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE 5 < l_linenumber")
R.sql("filter_or_of_ranges", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (l_orderkey > 100 AND l_orderkey < 1000) OR (l_orderkey > 2000 AND l_orderkey < 5000)")
R.sql("filter_and_or_mixed", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_orderkey % 7 = 0 AND (l_quantity > 40 OR l_discount < 0.02) AND NOT l_returnflag = 'R'")
R.sql("filter_cast_text", "SELECT o_orderkey, o_custkey FROM {orders} WHERE CAST(o_custkey AS STRING) > '5'", "SELECT o_orderkey, o_custkey FROM {orders} WHERE CAST(o_custkey AS VARCHAR) > '5'")
R.sql("filter_in_list", "SELECT n_nationkey, n_name FROM {nation} WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 3)")
R.sql("filter_null_tests", "SELECT count(*) AS n, count(x) AS nx FROM (SELECT CASE WHEN l_linenumber > 3 THEN l_linenumber END AS x FROM {lineitem}) AS t WHERE x IS NULL OR x IS NOT NULL")
R.sql("filter_three_valued", "SELECT k FROM (SELECT l_orderkey AS k, CASE WHEN l_linenumber > 3 THEN l_linenumber END AS x FROM {lineitem}) AS t WHERE x > 4 OR (x < 0 AND k > 0)")
R.sql("filter_modulus", "SELECT o_orderkey FROM {orders} WHERE o_orderkey % 11 = 3")
R.sql("filter_like", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%a%' AND p_type ILIKE '%BRASS%'")
R.sql("filter_not_volatile", "SELECT count(*) AS n FROM {orders} WHERE o_orderkey > 0 AND o_totalprice > rand() - 1", "SELECT count(*) AS n FROM {orders} WHERE o_orderkey > 0 AND o_totalprice > random() - 1")
R.sql("filter_parameter", "SELECT count(*) AS n FROM {lineitem} WHERE l_orderkey > (SELECT max(o_orderkey) / 2 FROM {orders})")


@R.frame("filter_prepared", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey > 50 AND o_orderstatus = 'F'")
def _(read, spark):
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {o} WHERE o_custkey > :low AND o_orderstatus = :status", args={"low": 50, "status": "F"}, o=read("orders"))


#: One query for each family of typed comparisons: the operands' types and a constant.
FAMILIES = {
    "char": ("lineitem", "l_returnflag", "'N'", "'N'"),
    "short": ("lineitem", "CAST(l_linenumber AS SMALLINT)", "CAST(3 AS SMALLINT)", None),
    "short_int": ("lineitem", "CAST(l_linenumber AS SMALLINT)", "CAST(3 AS INT)", None),
    "short_long": ("lineitem", "CAST(l_linenumber AS SMALLINT)", "CAST(3 AS BIGINT)", None),
    "int": ("lineitem", "l_linenumber", "CAST(3 AS INT)", None),
    "int_short": ("lineitem", "l_linenumber", "CAST(3 AS SMALLINT)", None),
    "int_long": ("lineitem", "l_linenumber", "CAST(3 AS BIGINT)", None),
    "long": ("lineitem", "l_suppkey", "CAST(50 AS BIGINT)", None),
    "long_short": ("lineitem", "l_suppkey", "CAST(50 AS SMALLINT)", None),
    "long_int": ("lineitem", "l_suppkey", "CAST(50 AS INT)", None),
    "date": ("orders", "CAST(o_orderdate AS DATE)", "DATE '1996-06-01'", None),
    "time": ("events", "date_format(ts, 'HH:mm:ss')", "'12:00:00'", "'12:00:00'"),
    "timestamp": ("lineitem", "l_shipdate", "TIMESTAMP_NTZ '1996-06-01'", "TIMESTAMP '1996-06-01'"),
    "timestamptz": ("lineitem", "CAST(l_shipdate AS TIMESTAMP)", "TIMESTAMP '1996-06-01 00:00:00'", "TIMESTAMP '1996-06-01'"),
    "double": ("lineitem", "l_quantity", "CAST(25 AS DOUBLE)", None),
    "decimal": ("lineitem", "CAST(l_quantity AS DECIMAL(14,2))", "CAST(25 AS DECIMAL(14,2))", None),
}
for _name, (_table, _left, _right, _duck) in FAMILIES.items():
    _text = "SELECT " + ", ".join(f"count(*) FILTER (WHERE {_left} {op} {_right}) AS {label}" for op, label in (("=", "eq"), ("<>", "ne"), ("<", "lt"), (">", "gt"), ("<=", "le"), (">=", "ge"))) + f" FROM {{{_table}}}"
    R.sql(f"compare_{_name}", _text, _text.replace(_right, _duck or _right).replace("date_format(ts, 'HH:mm:ss')", "strftime(ts, '%H:%M:%S')"))
