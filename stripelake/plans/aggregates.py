"""Aggregates, grouping and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import Registry

R = Registry()

R.sql(
    "agg_plain",
    """SELECT count(*) AS n, count(l_linenumber) AS nl, sum(CAST(l_linenumber AS BIGINT)) AS s4, sum(l_suppkey) AS s8, avg(l_linenumber) AS a4, avg(l_suppkey) AS a8,
min(l_linenumber) AS lo4, max(l_linenumber) AS hi4, min(l_orderkey) AS lo8, max(l_orderkey) AS hi8 FROM {lineitem}""",
    """SELECT count(*) AS n, count(l_linenumber) AS nl, CAST(sum(l_linenumber) AS BIGINT) AS s4, CAST(sum(l_suppkey) AS BIGINT) AS s8, avg(l_linenumber) AS a4, avg(l_suppkey) AS a8,
min(l_linenumber) AS lo4, max(l_linenumber) AS hi4, min(l_orderkey) AS lo8, max(l_orderkey) AS hi8 FROM {lineitem}""",
)
R.sql("agg_short", "SELECT sum(x) AS s, avg(x) AS a, min(x) AS lo, max(x) AS hi FROM (SELECT CAST(l_linenumber AS SMALLINT) AS x FROM {lineitem})", "SELECT CAST(sum(x) AS BIGINT) AS s, avg(x) AS a, min(x) AS lo, max(x) AS hi FROM (SELECT CAST(l_linenumber AS SMALLINT) AS x FROM {lineitem})")
R.sql("agg_date", "SELECT CAST(min(CAST(o_orderdate AS DATE)) AS STRING) AS lo, CAST(max(CAST(o_orderdate AS DATE)) AS STRING) AS hi FROM {orders}", "SELECT CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS lo, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS hi FROM {orders}")
R.sql("agg_timestamp", "SELECT min(ts) AS lo, max(ts) AS hi, count(DISTINCT ts) AS n FROM {events}")
R.sql("agg_empty_input", "SELECT count(*) AS n, count(l_orderkey) AS c, sum(l_orderkey) AS s, avg(l_orderkey) AS a, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM {lineitem} WHERE l_orderkey < 0", "SELECT count(*) AS n, count(l_orderkey) AS c, CAST(sum(l_orderkey) AS BIGINT) AS s, avg(l_orderkey) AS a, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM {lineitem} WHERE l_orderkey < 0")
R.sql("agg_exact_long", "SELECT CAST(sum(CAST(l_orderkey AS DECIMAL(20,0)) * 4611686018427387) AS STRING) AS s FROM {lineitem}", "SELECT CAST(sum(CAST(l_orderkey AS HUGEINT) * 4611686018427387) AS VARCHAR) AS s FROM {lineitem}")
R.sql("agg_distinct", "SELECT count(DISTINCT l_suppkey) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM {lineitem}")
R.sql("agg_distinct_rows", "SELECT count(DISTINCT l_returnflag, l_linestatus) AS n FROM {lineitem}", "SELECT count(DISTINCT (l_returnflag, l_linestatus)) AS n FROM {lineitem}")
R.sql("agg_filter_clause", "SELECT count(*) FILTER (WHERE l_linenumber > 3) AS n, CAST(sum(l_linenumber) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS s FROM {lineitem}")
R.sql("agg_constant_and_expression", "SELECT count(1) AS n, CAST(sum(2) AS BIGINT) AS two, CAST(sum(l_linenumber + l_suppkey) AS BIGINT) AS s, CAST(sum(length(l_returnflag)) AS BIGINT) AS len FROM {lineitem}")
R.sql("agg_float", "SELECT round(sum(l_extendedprice), 2) AS s, round(avg(l_discount), 8) AS a, min(l_tax) AS lo, max(l_tax) AS hi FROM {lineitem}")
R.sql("agg_numeric", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS STRING) AS s, min(CAST(l_quantity AS DECIMAL(14,0))) AS lo FROM {lineitem}", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS VARCHAR) AS s, min(CAST(l_quantity AS DECIMAL(14,0))) AS lo FROM {lineitem}")
R.sql("agg_stddev", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS v FROM {lineitem} GROUP BY l_returnflag")
R.sql("agg_string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey")
R.sql("agg_array", "SELECT n_regionkey, array_join(array_sort(collect_list(n_nationkey)), ',') AS ids, size(collect_list(n_nationkey)) AS n FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_nationkey)), ',') AS ids, CAST(len(list(n_nationkey)) AS INTEGER) AS n FROM {nation} GROUP BY n_regionkey")
R.sql("group_by_key", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS p FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
R.sql("group_by_high_cardinality", "SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS p FROM {lineitem} GROUP BY l_orderkey")
R.sql("group_by_expression", "SELECT year(o_orderdate) AS y, o_orderpriority, count(*) AS n FROM {orders} GROUP BY year(o_orderdate), o_orderpriority", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ALL")
R.sql("group_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 10")
R.sql("group_having_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM {lineitem} GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 20")
R.sql("group_order_by_aggregate", "SELECT l_suppkey, round(sum(l_quantity) - avg(l_tax) - coalesce(max(l_linenumber) * 5, 0), 4) AS x FROM {lineitem} GROUP BY l_suppkey ORDER BY x DESC, l_suppkey LIMIT 10")
R.sql("group_distinct", "SELECT DISTINCT l_shipdate, l_returnflag FROM {lineitem} WHERE l_quantity < 5")
R.sql("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
R.sql("grouping_rollup", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM {customer} GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
R.sql("grouping_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
R.sql("agg_percentile", "SELECT l_returnflag, percentile(l_quantity, 0.5) AS med, percentile(l_quantity, 0.9) AS p90 FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS med, quantile_cont(l_quantity, 0.9) AS p90 FROM {lineitem} GROUP BY l_returnflag")


@R.frame("agg_exact_integers", "SELECT l_returnflag, CAST(sum(l_orderkey * 4611686018427::HUGEINT) AS VARCHAR) AS s, round(avg(l_suppkey), 6) AS a FROM lineitem GROUP BY l_returnflag")
def _(read, spark):
    from ..functions.aggregates import exact_avg, exact_sum

    rows = read("lineitem").withColumn("big", F.col("l_orderkey").cast("decimal(20,0)") * F.lit(4611686018427))
    return rows.groupBy("l_returnflag").agg(exact_sum("big").cast("string").alias("s"), F.round(exact_avg("l_suppkey").cast("double"), 6).alias("a"))


@R.frame("agg_user_defined", "SELECT c_mktsegment, round(sqrt(avg(c_acctbal * c_acctbal)), 6) AS rms FROM customer GROUP BY c_mktsegment")
def _(read, spark):
    from ..functions.aggregates import root_mean_square

    return read("customer").groupBy("c_mktsegment").agg(F.round(root_mean_square("c_acctbal"), 6).alias("rms"))


@R.frame("agg_approximate")
def _(read, spark):
    return read("lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median"))


@R.frame("agg_skewed_two_step", "SELECT l_returnflag, count(*) AS n, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag")
def _(read, spark):
    from ..operators.skew import two_step

    return two_step(read("lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], {"n": F.count("*"), "hi": F.max("l_extendedprice")}, {"n": F.sum("n"), "hi": F.max("hi")})


R.sql("window_ranking", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)", "SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER w AS INTEGER) AS rk, CAST(dense_rank() OVER w AS INTEGER) AS dr FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)")
R.sql("window_offset", "SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2) OVER w AS next2, first_value(o_orderkey) OVER w AS f FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
R.sql("window_frame", "SELECT l_orderkey, l_linenumber, sum(CAST(l_linenumber AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s, max(l_quantity) OVER (PARTITION BY l_orderkey) AS hi FROM {lineitem}", "SELECT l_orderkey, l_linenumber, CAST(sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, max(l_quantity) OVER (PARTITION BY l_orderkey) AS hi FROM {lineitem}")
R.sql("window_distribution", "SELECT c_custkey, ntile(4) OVER w AS q, round(percent_rank() OVER w, 8) AS p, round(cume_dist() OVER w, 8) AS d FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)", "SELECT c_custkey, CAST(ntile(4) OVER w AS INTEGER) AS q, round(percent_rank() OVER w, 8) AS p, round(cume_dist() OVER w, 8) AS d FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)")
