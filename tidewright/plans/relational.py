"""Queries over the star-schema tables: scans, joins, aggregates, windows, sorts and set operations by inventory id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import checks as K
from ..schema import assert_unique
from ..sources.adapt import table as t
from .registry import query


@query("q01_pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base_price, sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price,
  avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2""", "sum_qty sum_base_price sum_disc_price avg_qty avg_disc", 2)
def q01(spark, sf):
    x = t(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.to_timestamp_ntz(F.lit("2000-09-02 00:00:00")))
    return x.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_base_price"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_disc_price"),
        F.avg("l_quantity").alias("avg_qty"), F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("count_order"),
    )


@query("q05_regional_revenue", "SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1", "revenue", 2)
def q05(spark, sf):
    c, o, x, s, n = (t(spark, sf, k) for k in ("customer", "orders", "lineitem", "supplier", "nation"))
    x = x.select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    j = x.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(s.select("s_suppkey", "s_nationkey"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return j.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("v").alias("revenue"))


@query("q06_filtered_sum", "SELECT sum(l_extendedprice * l_discount) AS revenue, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24", "revenue", 2)
def q06(spark, sf):
    x = t(spark, sf, "lineitem").where("l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24")
    return x.agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("j01_full_outer_provenance", "SELECT coalesce(CAST(p_partkey AS BIGINT), CAST(s_suppkey AS BIGINT)) AS k, CASE WHEN p_partkey IS NULL THEN 'right_only' WHEN s_suppkey IS NULL THEN 'left_only' ELSE 'both' END AS provenance FROM (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) FULL OUTER JOIN supplier ON p_partkey = s_suppkey")
def j01(spark, sf):
    p = t(spark, sf, "part").where("p_partkey % 3 = 0").select("p_partkey")
    j = p.join(t(spark, sf, "supplier").select("s_suppkey"), F.col("p_partkey") == F.col("s_suppkey"), "full_outer")
    return j.select(F.coalesce("p_partkey", "s_suppkey").alias("k"), F.when(F.col("p_partkey").isNull(), "right_only").when(F.col("s_suppkey").isNull(), "left_only").otherwise("both").alias("provenance"))


@query("j02_left_outer", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j02(spark, sf):
    o = t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    j = t(spark, sf, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("j03_shifted_self_join", "SELECT a.o_orderkey, b.o_totalprice - a.o_totalprice AS difference FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey + 10", "difference", 2)
def j03(spark, sf):
    a = t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    b = a.select((F.col("o_orderkey") - 10).alias("o_orderkey"), F.col("o_totalprice").alias("later"))
    return a.join(b, "o_orderkey", "left").select("o_orderkey", (F.col("later") - F.col("o_totalprice")).alias("difference"))


@query("j04_folded_group_results", "SELECT o_custkey, sum(o_totalprice) AS total, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS finished, max(o_orderdate) AS last_date FROM orders GROUP BY 1", "total finished", 2)
def j04(spark, sf):
    p = F.col("o_totalprice")
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(p).alias("total"), F.sum(F.when(F.col("o_orderstatus") == "F", p)).alias("finished"), F.max("o_orderdate").alias("last_date"))


@query("j08_left_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j08(spark, sf):
    big = t(spark, sf, "orders").where("o_totalprice > 300000")
    return t(spark, sf, "customer").select("c_custkey").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("j09_left_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def j09(spark, sf):
    return t(spark, sf, "customer").select("c_custkey").join(t(spark, sf, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("j12_broadcast_dimension", "SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def j12(spark, sf):
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.sum("n").alias("customers"))


@query("j14_unique_key", "SELECT count(*) AS n FROM orders")
def j14(spark, sf):
    return assert_unique(t(spark, sf, "orders"), ["o_orderkey"], "orders").agg(F.count(F.lit(1)).alias("n"))


@query("a13_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "total", 1)
def a13(spark, sf):
    return t(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("a34_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def a34(spark, sf):
    return t(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("a05_exact_percentiles", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.9) AS p90, median(l_quantity) AS mq, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY 1", "p50 p90 mq sd", 4)
def a05(spark, sf):
    q = F.percentile("l_extendedprice", F.array(F.lit(0.5), F.lit(0.9)))
    x = t(spark, sf, "lineitem").groupBy("l_returnflag").agg(q.alias("q"), F.median("l_quantity").alias("mq"), F.stddev_samp("l_quantity").alias("sd"))
    return x.select("l_returnflag", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"), "mq", "sd")


@query("w15_rank_in_group", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders")
def w15(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank"))


@query("o01_sorted_columns", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey")
def o01(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", "o_orderpriority").orderBy("o_orderpriority", "o_orderkey")


@query("o02_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", "o_totalprice", 2)
def o02(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("p13_p14_projection", "SELECT n_nationkey AS nation_nationkey, n_name AS nation_name FROM nation")
def p13(spark, sf):
    columns = list(dict.fromkeys(["n_nationkey", "n_name", "n_nationkey"]))
    return t(spark, sf, "nation").select(*[F.col(c).alias(f"nation_{c[2:]}") for c in columns])


@query("u01_union_all", "SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def u01(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    return n.unionByName(t(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind")))


@query("u03_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def u03(spark, sf):
    return t(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("k")).intersect(t(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k")))


@query("u03_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def u03_except(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("k")).subtract(t(spark, sf, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("k")))


@query("u04_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def u04(spark, sf):
    return t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("u05_key_sets", "SELECT count_if(b IS NULL) AS only_first, count_if(a IS NULL) AS only_second, count_if(a IS NOT NULL AND b IS NOT NULL) AS both FROM (SELECT DISTINCT o_custkey AS a FROM orders) FULL OUTER JOIN (SELECT DISTINCT c_custkey AS b FROM customer) ON a = b")
def u05(spark, sf):
    return K.same_ids(t(spark, sf, "orders").select(F.col("o_custkey").alias("k")), t(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("n21_json_fields", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def n21(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))
