"""Window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserql.queries.registry import query
from tesserql.sources.tables import table


@query("""
    SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rnk, dense_rank() OVER v AS dense
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)
""")
def win_rank_family(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.row_number().over(w).cast("bigint").alias("rn"), F.rank().over(v).cast("bigint").alias("rnk"), F.dense_rank().over(v).cast("bigint").alias("dense")
    )


@query("""
    SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lag(o_orderkey, 2, -1) OVER w AS before2, lead(o_orderkey) OVER w AS after
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def win_lag_lead(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.lag(k).over(w).alias("before"), F.lag(k, 2, -1).over(w).alias("before2"), F.lead(k).over(w).alias("after"))


@query("""
    SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER w AS last_key, nth_value(o_orderkey, 2) OVER w AS second_key
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def win_first_last_nth(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.first(k).over(w).alias("first_key"), F.last(k).over(w).alias("last_key"), F.nth_value(k, 2).over(w).alias("second_key"))


@query("""
    SELECT s_suppkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 8) AS percent, round(cume_dist() OVER w, 8) AS cume
    FROM supplier WINDOW w AS (PARTITION BY s_nationkey % 5 ORDER BY s_acctbal, s_suppkey)
""")
def win_ntile_cume_percent(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy(F.col("s_nationkey") % 5).orderBy("s_acctbal", "s_suppkey")
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.ntile(4).over(w).cast("bigint").alias("quarter"), F.round(F.percent_rank().over(w), 8).alias("percent"), F.round(F.cume_dist().over(w), 8).alias("cume")
    )


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM events")
def win_running_sum(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf, "events").select("event_id", F.round(F.sum("value").over(w), 6).alias("running"))


@query("""
    SELECT l_orderkey, l_linenumber, count(*) OVER w AS n, min(l_quantity) OVER w AS least, max(l_quantity) OVER w AS most
    FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)
""")
def win_rows_frame(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber").rowsBetween(-2, 1)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.count("*").over(w).alias("n"), F.min("l_quantity").over(w).alias("least"), F.max("l_quantity").over(w).alias("most")
    )


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM part")
def win_range_frame(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-3, 3)
    return table(spark, sf, "part").select("p_partkey", F.count("*").over(w).alias("near"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS month FROM orders")
def win_range_interval(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(
        "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate "
        "RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS month FROM {orders}",
        orders=table(spark, sf, "orders"),
    )


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS upto, count(*) OVER (PARTITION BY p_brand) AS whole FROM part")
def win_default_frames(spark: SparkSession, sf: str) -> DataFrame:
    whole = Window.partitionBy("p_brand")
    return table(spark, sf, "part").select("p_partkey", F.count("*").over(whole.orderBy("p_size")).alias("upto"), F.count("*").over(whole).alias("whole"))


@query("""
    SELECT o_orderkey, count(*) OVER w AS n, row_number() OVER (w ORDER BY o_totalprice, o_orderkey) AS rn
    FROM orders WINDOW w AS (PARTITION BY o_custkey)
""")
def win_named(spark: SparkSession, sf: str) -> DataFrame:
    """A window that inherits another's partitions."""
    w = Window.partitionBy("o_custkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy("o_totalprice", "o_orderkey")).cast("bigint").alias("rn")
    )


@query("""
    SELECT c_nationkey, c_mktsegment, n, CAST(sum(n) OVER (PARTITION BY c_nationkey) AS BIGINT) AS per_nation,
           rank() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, c_nationkey) AS place
    FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)
""")
def win_over_groups(spark: SparkSession, sf: str) -> DataFrame:
    grouped = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    place = Window.partitionBy("c_mktsegment").orderBy(F.desc("n"), "c_nationkey")
    return grouped.select(
        "c_nationkey", "c_mktsegment", "n", F.sum("n").over(Window.partitionBy("c_nationkey")).alias("per_nation"), F.rank().over(place).cast("bigint").alias("place")
    )


@query("""
    SELECT n_nationkey, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) || ']' AS so_far
    FROM nation
""")
def win_json_array(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return table(spark, sf, "nation").select("n_nationkey", F.to_json(F.collect_list("n_nationkey").over(w)).alias("so_far"))
