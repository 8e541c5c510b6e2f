"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserql.operators import joins as j
from tesserql.plans.sizes import broadcast_if_small
from tesserql.queries.registry import query
from tesserql.sources.tables import table


@query("""
    SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_totalprice > 150000
""")
def join_inner(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").where("o_totalprice > 150000")
    customers = table(spark, sf, "customer").join(broadcast_if_small(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000 GROUP BY c_custkey")
def join_left(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_custkey")
    joined = table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT o_orderkey, s_suppkey, s_name FROM orders RIGHT JOIN supplier ON o_orderkey = s_suppkey")
def join_right(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey")
    return orders.join(table(spark, sf, "supplier"), F.col("o_orderkey") == F.col("s_suppkey"), "right").select("o_orderkey", "s_suppkey", "s_name")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").crossJoin(table(spark, sf, "nation")).select("r_name", "n_name")


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "nation").alias("a"), table(spark, sf, "nation").alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("a_name"), F.col("b.n_name").alias("b_name"))


@query("SELECT r_regionkey, n_nationkey FROM region JOIN nation ON r_regionkey < n_regionkey")
def join_theta(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("r_regionkey") < F.col("n_regionkey")).select("r_regionkey", "n_nationkey")


@query("SELECT k, name_left, name_right FROM (SELECT n_nationkey AS k, n_name AS name_left FROM nation) a JOIN (SELECT r_regionkey AS k, r_name AS name_right FROM region) b USING (k)")
def join_using(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name_left"))
    b = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name_right"))
    return j.using(a, b, ["k"])


@query("SELECT k, name_left, name_right FROM (SELECT n_nationkey AS k, n_name AS name_left FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS name_right FROM region) b")
def join_natural(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name_left"))
    b = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name_right"))
    return j.natural(a, b)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_semi_in(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").where("o_totalprice > 200000")
    return j.semi(table(spark, sf, "customer"), big, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name")


@query("""
    SELECT o_orderkey FROM orders WHERE EXISTS
    (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45 AND l_shipdate > o_orderdate)
""")
def join_semi_exists(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").where("l_quantity > 45")
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate"))
    return j.semi(table(spark, sf, "orders"), items, on).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_anti_not_exists(spark: SparkSession, sf: str) -> DataFrame:
    finished = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return j.anti(table(spark, sf, "customer"), finished, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey END NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def join_anti_not_in_nulls(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey END").alias("k"))
    return j.not_in(parts, "k", table(spark, sf, "lineitem").where("l_quantity > 48"), "l_partkey").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT CASE WHEN l_quantity > 49 THEN NULL ELSE l_partkey END FROM lineitem)")
def join_anti_not_in_null_member(spark: SparkSession, sf: str) -> DataFrame:
    others = table(spark, sf, "lineitem").select(F.expr("CASE WHEN l_quantity > 49 THEN NULL ELSE l_partkey END").alias("k"))
    return j.not_in(table(spark, sf, "part"), "p_partkey", others, "k").select("p_partkey")


@query("SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def join_left_is_null(spark: SparkSession, sf: str) -> DataFrame:
    return j.anti(table(spark, sf, "customer"), table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("""
    SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL
    (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t
""")
def join_lateral_topn(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    customers = table(spark, sf, "customer").select("c_custkey")
    return j.lateral_top(customers, orders, "c_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)


@query("""
    SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem
    JOIN (SELECT p_partkey, p_size * 40.0 AS low, p_size * 40.0 + 25 AS high FROM part) p
    ON l_extendedprice BETWEEN low AND high
""")
def join_range(spark: SparkSession, sf: str) -> DataFrame:
    return _in_ranges(spark, sf, table(spark, sf, "part"))


def _in_ranges(spark: SparkSession, sf: str, parts: DataFrame) -> DataFrame:
    ranges = parts.select("p_partkey", (F.col("p_size") * 40.0).alias("low"), (F.col("p_size") * 40.0 + 25).alias("high"))
    points = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return j.range_join(points, "l_extendedprice", ranges, "low", "high", 50.0).select("l_orderkey", "l_linenumber", "p_partkey")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_suppkey = c_custkey OR s_name = replace(c_name, 'Customer', 'Supplier')")
def join_or(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    customers = table(spark, sf, "customer").select("c_custkey", F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("as_supplier"))
    conditions = [F.col("s_suppkey") == F.col("c_custkey"), F.col("s_name") == F.col("as_supplier")]
    return j.any_of(suppliers, customers, conditions, []).select("s_suppkey", "c_custkey")


@query("""
    SELECT event_type, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM events JOIN customer ON user_id = c_custkey GROUP BY event_type
""")
def join_salted(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(F.col("user_id").alias("k"), "event_id", "event_type")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    joined = j.salted(events, customers, "k", 8)
    return joined.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("""
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer, orders, lineitem, supplier, nation, region
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
      AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
    GROUP BY n_name
""")
def join_star(spark: SparkSession, sf: str) -> DataFrame:
    regions = table(spark, sf, "region").where("r_name = 'ASIA'")
    nations = table(spark, sf, "nation").join(broadcast_if_small(regions), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    suppliers = table(spark, sf, "supplier").join(broadcast_if_small(nations), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    joined = items.join(broadcast_if_small(suppliers), F.col("l_suppkey") == F.col("s_suppkey")).join(
        orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))
    )
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
