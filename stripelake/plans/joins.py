"""Joins and subqueries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import Registry

R = Registry()

R.sql("join_inner", "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000")
R.sql("join_sort_merge", "SELECT /*+ MERGE(o) */ l.l_orderkey, l.l_linenumber, o.o_orderstatus FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity > 45", "SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity > 45")
R.sql("join_shuffle_hash", "SELECT /*+ SHUFFLE_HASH(o) */ l.l_returnflag, count(*) AS n FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey GROUP BY l.l_returnflag", "SELECT l.l_returnflag, count(*) AS n FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey GROUP BY l.l_returnflag")
R.sql("join_nested_loop", "SELECT r.r_name, n.n_name FROM {region} r JOIN {nation} n ON n.n_nationkey < r.r_regionkey * 2")
R.sql("join_theta_and_equal", "SELECT a.l_orderkey, a.l_linenumber AS la, b.l_linenumber AS lb FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber > b.l_linenumber AND a.l_quantity > b.l_quantity")
R.sql(
    "join_eight_way",
    """SELECT r.r_name, count(*) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM {region} r JOIN {nation} n ON n.n_regionkey = r.r_regionkey JOIN {customer} c ON c.c_nationkey = n.n_nationkey JOIN {orders} o ON o.o_custkey = c.c_custkey
JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey JOIN {supplier} s ON s.s_suppkey = l.l_suppkey JOIN {part} p ON p.p_partkey = l.l_partkey JOIN {nation} sn ON sn.n_nationkey = s.s_nationkey
WHERE p.p_size < 25 GROUP BY r.r_name""",
)
R.sql("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 100000 GROUP BY c.c_custkey")
R.sql("join_right", "SELECT n.n_name, r.r_name FROM {nation} n RIGHT JOIN {region} r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey < 8")
R.sql("join_full", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT * FROM {nation} WHERE n_nationkey < 10) a FULL JOIN (SELECT * FROM {nation} WHERE n_nationkey > 5) b ON a.n_nationkey = b.n_nationkey")
R.sql("join_cross", "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n")
R.sql("join_lateral_aggregate", "SELECT c.c_custkey, t.n, t.top FROM {customer} c, LATERAL (SELECT count(*) AS n, max(o_totalprice) AS top FROM {orders} o WHERE o.o_custkey = c.c_custkey) t")
R.sql("join_left_lateral", "SELECT n.n_nationkey, t.s FROM {nation} n LEFT JOIN LATERAL (SELECT sum(r_regionkey) AS s FROM {region} r WHERE r.r_regionkey > n.n_regionkey) t ON true", "SELECT n.n_nationkey, CAST(t.s AS BIGINT) AS s FROM {nation} n LEFT JOIN LATERAL (SELECT sum(r_regionkey) AS s FROM {region} r WHERE r.r_regionkey > n.n_regionkey) t ON true")
R.sql("join_lateral_series", "SELECT r_regionkey, g FROM {region} LATERAL VIEW explode(sequence(0, r_regionkey)) t AS g", "SELECT r_regionkey, CAST(g AS INTEGER) AS g FROM {region}, LATERAL (SELECT unnest(generate_series(0, r_regionkey)) AS g) t")
R.sql("join_natural", "SELECT k, a, b, c FROM (SELECT n_nationkey AS k, n_name AS a FROM {nation}) x NATURAL JOIN (SELECT n_nationkey AS k, n_regionkey AS b FROM {nation}) y NATURAL JOIN (SELECT n_nationkey AS k, length(n_name) AS c FROM {nation}) z", "SELECT k, a, b, CAST(c AS INTEGER) AS c FROM (SELECT n_nationkey AS k, n_name AS a FROM {nation}) x NATURAL JOIN (SELECT n_nationkey AS k, n_regionkey AS b FROM {nation}) y NATURAL JOIN (SELECT n_nationkey AS k, length(n_name) AS c FROM {nation}) z")
R.sql("join_on_cast", "SELECT CAST(n.n_regionkey AS STRING) AS k, count(*) AS n FROM {nation} n JOIN {region} r ON CAST(n.n_regionkey AS STRING) = CAST(r.r_regionkey AS STRING) GROUP BY 1", "SELECT CAST(n.n_regionkey AS VARCHAR) AS k, count(*) AS n FROM {nation} n JOIN {region} r ON CAST(n.n_regionkey AS VARCHAR) = CAST(r.r_regionkey AS VARCHAR) GROUP BY 1")
R.sql("join_comma", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a, {nation} b WHERE a.n_nationkey = b.n_nationkey + 5 AND a.n_regionkey <> b.n_regionkey")
R.sql("join_self_cte", "WITH w AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT a.o_custkey, a.n FROM w a JOIN w b ON a.o_custkey = b.o_custkey AND a.n = b.n WHERE a.n > 5")
R.sql("join_semi", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000)")
R.sql("join_anti", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)")
R.sql("join_anti_null_aware", "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey > 2 THEN r_regionkey ELSE 1 END FROM {region})")
R.sql("join_anti_with_null", "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey > 2 THEN r_regionkey END FROM {region})")
R.sql("subquery_scalar_correlated", "SELECT n.n_name, (SELECT count(*) FROM {customer} c WHERE c.c_nationkey = n.n_nationkey) AS n FROM {nation} n")
R.sql("subquery_scalar", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 2 FROM {orders})")
R.sql("subquery_exists", "SELECT s_suppkey FROM {supplier} s WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)")
R.sql("join_range", "SELECT e.event_id, o.k FROM {events} e JOIN (SELECT r_regionkey AS k, r_regionkey * 20 AS low, r_regionkey * 20 + 10 AS high FROM {region}) o ON e.value >= o.low AND e.value < o.high")


@R.frame("join_as_of", "SELECT a.event_id, b.event_id AS prior FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT ts, user_id, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ts, user_id) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def _(read, spark):
    # One pass over both sides in time order: the last click's id at or before each purchase.
    e = read("events")
    clicks = F.when(F.col("event_type") == "click", F.col("event_id"))
    order = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("event_type") == "click", F.struct("ts", F.col("event_id").alias("id")))).over(order)
    return e.where("event_type in ('click', 'purchase')").select("event_id", "event_type", last["id"].alias("prior"), clicks.alias("own")).where("event_type = 'purchase'").select("event_id", "prior")


@R.frame("join_skew_salted", "SELECT l.l_returnflag, o.o_orderpriority, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY ALL")
def _(read, spark):
    from ..operators.skew import salted_join

    return salted_join(read("lineitem").select("l_orderkey", "l_returnflag"), read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey", salts=4).groupBy("l_returnflag", "o_orderpriority").agg(F.count("*").alias("n"))


@R.frame("join_co_partitioned", "SELECT o.o_orderpriority, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderpriority")
def _(read, spark):
    # both sides are dealt once by the join key into the same partitions, so the join itself moves nothing
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = read("lineitem").select("l_orderkey").repartition(parts, "l_orderkey")
    right = read("orders").select("o_orderkey", "o_orderpriority").repartition(parts, "o_orderkey")
    return left.hint("merge").join(right, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@R.frame("join_range_keys", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON (a.n_regionkey >= a.n_nationkey % 7 AND b.n_nationkey % 5 >= b.n_regionkey * 2) OR (a.n_regionkey < a.n_nationkey % 7 AND b.n_nationkey % 5 < b.n_regionkey * 2 AND a.n_regionkey = b.n_nationkey % 5 AND a.n_nationkey % 7 = b.n_regionkey * 2)")
def _(read, spark):
    from ..functions import ranges as r

    a = read("nation").select(F.col("n_nationkey").alias("a"), r.key(r.make(F.col("n_regionkey"), F.col("n_nationkey") % 7)).alias("ra"))
    b = read("nation").select(F.col("n_nationkey").alias("b"), r.key(r.make(F.col("n_nationkey") % 5, F.col("n_regionkey") * 2)).alias("rb"))
    return a.join(b, F.col("ra").eqNullSafe(F.col("rb"))).select("a", "b")
