"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import Registry

R = Registry()

R.sql("scalar_arithmetic", "SELECT l_orderkey, l_linenumber, l_suppkey div 7 AS q, l_suppkey % 7 AS m, -l_linenumber AS neg, round(l_quantity / 3, 6) AS d FROM {lineitem}", "SELECT l_orderkey, l_linenumber, l_suppkey // 7 AS q, l_suppkey % 7 AS m, -l_linenumber AS neg, round(l_quantity / 3, 6) AS d FROM {lineitem}")
R.sql("scalar_rounding", "SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, abs(c_acctbal) AS a, least(c_acctbal, 100.0D, 5000.0D) AS lo, greatest(c_acctbal, 100.0D) AS hi FROM {customer}", "SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, abs(c_acctbal) AS a, least(c_acctbal, CAST(100.0 AS DOUBLE), CAST(5000.0 AS DOUBLE)) AS lo, greatest(c_acctbal, CAST(100.0 AS DOUBLE)) AS hi FROM {customer}")
R.sql("scalar_case_coalesce", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'zero' WHEN n_regionkey < 3 THEN 'few' ELSE 'many' END AS k, coalesce(nullif(n_regionkey, 1), -1) AS x FROM {nation}")
R.sql("scalar_strings", "SELECT p_partkey, length(p_name) AS n, upper(p_name) AS u, substr(p_name, 2, 3) AS s, repeat(p_brand, 2) AS r, concat_ws('', p_brand, NULL, p_type) AS c, p_brand || '-' || p_type AS o, lpad(CAST(p_size AS STRING), 4, '0') AS z FROM {part}", "SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n, upper(p_name) AS u, substr(p_name, 2, 3) AS s, repeat(p_brand, 2) AS r, concat(p_brand, NULL, p_type) AS c, p_brand || '-' || p_type AS o, lpad(CAST(p_size AS VARCHAR), 4, '0') AS z FROM {part}")
R.sql("scalar_md5", "SELECT n_nationkey, md5(n_name) AS m FROM {nation}")
R.sql("scalar_uuid_from_md5", "SELECT n_nationkey, regexp_replace(md5(n_name), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5') AS u FROM {nation}", "SELECT n_nationkey, regexp_replace(md5(n_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS u FROM {nation}")
R.sql("scalar_regex", "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS d, regexp_replace(p_type, '[AEIOU]', '*') AS r FROM {part} WHERE p_name RLIKE '^[a-m]'", "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS d, regexp_replace(p_type, '[AEIOU]', '*', 'g') AS r FROM {part} WHERE regexp_matches(p_name, '^[a-m]')")
R.sql("scalar_datetime", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('MONTH', o_orderdate) AS t, o_orderdate + INTERVAL '3' DAY AS later, datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS n FROM {orders}", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t, o_orderdate + INTERVAL 3 DAY AS later, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS n FROM {orders}")
R.sql("scalar_epoch", "SELECT event_id, CAST(timestamp_seconds(event_id * 60) AS STRING) AS t FROM {events}", "SELECT event_id, strftime(make_timestamp(event_id * 60 * 1000000), '%Y-%m-%d %H:%M:%S') AS t FROM {events}")
R.sql("scalar_today", "SELECT count(*) AS n FROM {orders} WHERE CAST(o_orderdate AS DATE) <= current_date AND o_orderdate < current_timestamp")
R.sql("scalar_arrays", "SELECT n_nationkey, size(array(n_nationkey, n_regionkey)) AS n, array_max(array(n_nationkey, n_regionkey)) AS hi, array(n_nationkey, n_regionkey)[1] AS x FROM {nation}", "SELECT n_nationkey, CAST(len([n_nationkey, n_regionkey]) AS INTEGER) AS n, list_max([n_nationkey, n_regionkey]) AS hi, [n_nationkey, n_regionkey][2] AS x FROM {nation}")
R.sql("scalar_casts", "SELECT c_custkey, CAST(c_custkey AS STRING) AS s, CAST(CAST(c_custkey AS STRING) AS INT) AS i, CAST(c_nationkey AS DOUBLE) AS f, try_cast(c_name AS INT) AS bad FROM {customer}", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS s, CAST(CAST(c_custkey AS VARCHAR) AS INTEGER) AS i, CAST(c_nationkey AS DOUBLE) AS f, TRY_CAST(c_name AS INTEGER) AS bad FROM {customer}")
R.sql("scalar_json", "SELECT r_regionkey, get_json_object(j, '$.a') AS a, CAST(get_json_object(j, '$.b') AS BIGINT) AS b FROM (SELECT r_regionkey, to_json(named_struct('a', r_name, 'b', r_regionkey * 10)) AS j FROM {region})", "SELECT r_regionkey, json_extract_string(j, '$.a') AS a, CAST(json_extract(j, '$.b') AS BIGINT) AS b FROM (SELECT r_regionkey, json_object('a', r_name, 'b', r_regionkey * 10) AS j FROM {region})")
R.sql("scalar_blank_padded", "SELECT n_nationkey, rpad(n_name, 20, ' ') AS c FROM {nation}")


@R.frame("scalar_ranges", "SELECT count(*) FILTER (WHERE 10 >= lo AND 10 < hi) AS has10, count(*) FILTER (WHERE lo < 12 AND 8 < hi) AS overlaps, count(*) FILTER (WHERE lo >= hi) AS empty FROM (SELECT p_size AS lo, CAST(p_retailprice AS INT) % 50 AS hi FROM part)".replace("CAST(p_retailprice AS INT)", "CAST(floor(p_retailprice) AS INT)").replace("WHERE lo < 12 AND 8 < hi", "WHERE lo < hi AND lo < 12 AND 8 < hi"))
def _(read, spark):
    from ..functions import ranges as r

    x = r.make(F.col("lo"), F.col("hi"))
    rows = read("part").select(F.col("p_size").alias("lo"), (F.floor("p_retailprice").cast("int") % 50).alias("hi"))
    return rows.agg(F.count_if(r.contains(x, F.lit(10))).alias("has10"), F.count_if(r.overlaps(x, r.make(F.lit(8), F.lit(12)))).alias("overlaps"), F.count_if(r.is_empty(x)).alias("empty"))


@R.frame("scalar_geometry", "SELECT count(*) AS n FROM supplier a, nation b WHERE sqrt(power(a.s_suppkey % 10 - b.n_nationkey, 2) + power(a.s_nationkey - b.n_regionkey, 2)) <= 5")
def _(read, spark):
    from ..functions import geometry as g

    s, n = read("supplier"), read("nation")
    a, b = g.circle(F.col("s_suppkey") % 10, F.col("s_nationkey"), F.lit(2)), g.circle(F.col("n_nationkey"), F.col("n_regionkey"), F.lit(3))
    return s.crossJoin(F.broadcast(n)).where(g.circles_overlap(a, b)).agg(F.count("*").alias("n"))


@R.frame("scalar_infinite_dates", "SELECT count(*) AS n, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS hi FROM orders")
def _(read, spark):
    from ..functions import dates as d

    mixed = read("orders").select(F.col("o_orderdate").cast("date").alias("x")).unionByName(spark.range(1).select(d.infinity().alias("x")))
    return mixed.where(d.is_finite("x")).agg(F.count("*").alias("n"), F.max("x").cast("string").alias("hi"))


@R.frame("scalar_enum_order", "SELECT o_orderkey FROM orders ORDER BY array_position(['P', 'O', 'F'], o_orderstatus), o_orderkey LIMIT 20")
def _(read, spark):
    from ..functions.enums import rank

    return read("orders").orderBy(rank("o_orderstatus", ["P", "O", "F"]), "o_orderkey").limit(20).select("o_orderkey")


@R.frame("function_sql", "SELECT n_nationkey, n_nationkey * 2 + 1 AS x FROM nation")
def _(read, spark):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION stripelake_odd(x INT) RETURNS INT RETURN x * 2 + 1")
    return spark.sql("SELECT n_nationkey, stripelake_odd(n_nationkey) AS x FROM {n}", n=read("nation"))


@R.frame("function_batched", "SELECT c_custkey, round(c_acctbal * 1.1, 4) AS x FROM customer")
def _(read, spark):
    from ..functions.batched import scale

    return read("customer").select("c_custkey", F.round(scale("c_acctbal"), 4).alias("x"))


@R.frame("function_table", "SELECT r_regionkey, CAST(unnest(generate_series(0, r_regionkey * 2, 2)) AS INTEGER) AS g FROM region")
def _(read, spark):
    from ..functions.batched import Series

    spark.udtf.register("stripelake_series", Series)
    return spark.sql("SELECT r_regionkey, g FROM {r}, LATERAL stripelake_series(0, r_regionkey * 2, 2)", r=read("region"))


@R.frame("scalar_encryption", "SELECT n_nationkey, n_name AS x FROM nation")
def _(read, spark):
    key = F.lit("0123456789abcdef")
    return read("nation").select("n_nationkey", F.aes_decrypt(F.aes_encrypt("n_name", key), key).cast("string").alias("x"))


@R.frame("scalar_variant", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(read, spark):
    return read("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k"))


@R.frame("scalar_to_char", "SELECT c_custkey, CASE WHEN x < 0 THEN '-' ELSE '' END || CASE WHEN abs(x) >= 1000 THEN '###' ELSE lpad(CAST(abs(x) AS VARCHAR), 3, '0') END AS t FROM (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS x FROM customer)")
def _(read, spark):
    from ..functions.formats import zero_padded

    return read("customer").select("c_custkey", zero_padded(F.floor("c_acctbal"), 3).alias("t"))


@R.frame("scalar_boxes", "SELECT count(*) FILTER (WHERE least(s_suppkey % 10, 5) <= 7 AND greatest(s_suppkey % 10, 5) >= 3 AND least(s_nationkey, 9) <= 7 AND greatest(s_nationkey, 9) >= 3) AS boxes, count(*) FILTER (WHERE s_suppkey % 10 >= 4) AS circles FROM supplier")
def _(read, spark):
    from ..functions import geometry as g

    lit = F.lit
    mine = g.box(g.point(F.col("s_suppkey") % 10, F.col("s_nationkey")), g.point(lit(5), lit(9)))
    fixed = g.box(g.point(lit(3), lit(3)), g.point(lit(7), lit(7)))
    larger = g.at_least(g.circle(lit(0), lit(0), F.col("s_suppkey") % 10), g.circle(lit(1), lit(1), lit(4)))
    return read("supplier").agg(F.count_if(g.boxes_overlap(mine, fixed)).alias("boxes"), F.count_if(larger).alias("circles"))
