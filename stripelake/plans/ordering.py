"""Sorting, limits, set operations and common table expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import Registry

R = Registry()

R.sql("sort_multi_key", "SELECT c_custkey, c_nationkey FROM {customer} ORDER BY c_nationkey DESC NULLS LAST, 1 ASC NULLS LAST")
R.sql("sort_nulls_last", "SELECT k, x FROM (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS x FROM {lineitem}) AS t ORDER BY x ASC NULLS LAST, k, n")
R.sql("top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
R.sql("top_k_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 30")
R.sql("top_k_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) AS t WHERE rn <= 2")
R.sql("limit_in_subquery", "SELECT count(*) AS n, max(o_totalprice) AS hi FROM (SELECT o_totalprice FROM {orders} ORDER BY o_orderdate, o_orderkey LIMIT 100) AS t")
R.sql("set_union_all", "SELECT n_nationkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}")
R.sql("set_union_distinct", "SELECT o_orderstatus AS k, count(*) AS n FROM {orders} GROUP BY o_orderstatus UNION SELECT l_returnflag, count(*) FROM {lineitem} GROUP BY l_returnflag ORDER BY 1, 2")
R.sql("set_except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}")
R.sql("set_symmetric_difference", "(SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT r_regionkey * 2 FROM {region}) UNION (SELECT r_regionkey * 2 FROM {region} EXCEPT SELECT n_nationkey FROM {nation})")
R.sql("set_symmetric_difference_empty", "(SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT n_nationkey FROM {nation}) UNION (SELECT n_nationkey FROM {nation} EXCEPT SELECT n_nationkey FROM {nation})")
R.sql("set_intersect", "SELECT o_custkey AS k FROM {orders} WHERE o_totalprice > 150000 INTERSECT SELECT c_custkey FROM {customer} WHERE c_acctbal > 0")
R.sql("set_except_all", "SELECT l_returnflag AS f FROM {lineitem} EXCEPT ALL SELECT l_returnflag FROM {lineitem} WHERE l_quantity > 25")
R.sql("set_intersect_all", "SELECT l_returnflag AS f FROM {lineitem} INTERSECT ALL SELECT l_returnflag FROM {lineitem} WHERE l_quantity > 25")
R.sql("cte_plain", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM {orders} GROUP BY o_custkey), top AS (SELECT max(t) AS m FROM big) SELECT o_custkey, round(t, 2) AS t FROM big, top WHERE t > m * 0.8")
R.sql("cte_recursive", "WITH RECURSIVE s(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM s WHERE n < 15) SELECT n, f FROM s")


@R.frame("table_shorthand", "SELECT * FROM nation")
def _(read, spark):
    read("nation").createOrReplaceTempView("stripelake_nation")
    return spark.sql("TABLE stripelake_nation")


@R.frame("cte_materialized", "WITH w AS MATERIALIZED (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT a.n_regionkey, a.n + b.n AS n FROM w a JOIN w b ON a.n_regionkey = b.n_regionkey")
def _(read, spark):
    w = read("nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return w.alias("a").join(w.alias("b"), "n_regionkey").select("n_regionkey", (F.col("a.n") + F.col("b.n")).alias("n"))


@R.frame("knn_l2", "SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS d FROM embeddings ORDER BY d, vec_id LIMIT 10")
def _(read, spark):
    from ..operators.vector import l2_distance, top_k

    e = read("embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return top_k(e.crossJoin(F.broadcast(q)).select("vec_id", F.round(l2_distance("embedding", "q"), 6).alias("d")), "d", "vec_id", 10)


@R.frame("knn_cosine", "SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 1)), 6) AS d FROM embeddings ORDER BY d, vec_id LIMIT 10")
def _(read, spark):
    from ..operators.vector import cosine_distance, top_k

    e = read("embeddings")
    q = e.where("vec_id = 1").select(F.col("embedding").alias("q"))
    return top_k(e.crossJoin(F.broadcast(q)).select("vec_id", F.round(cosine_distance("embedding", "q"), 6).alias("d")), "d", "vec_id", 10)


@R.frame("knn_inner_product", "SELECT vec_id, round(-list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 2)), 6) AS d FROM embeddings ORDER BY d, vec_id LIMIT 10")
def _(read, spark):
    from ..operators.vector import inner_product, top_k

    e = read("embeddings")
    q = e.where("vec_id = 2").select(F.col("embedding").alias("q"))
    return top_k(e.crossJoin(F.broadcast(q)).select("vec_id", F.round(-inner_product("embedding", "q"), 6).alias("d")), "d", "vec_id", 10)
