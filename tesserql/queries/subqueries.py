"""Subqueries, derived tables and common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserql.operators import subqueries as s
from tesserql.queries.registry import query
from tesserql.sources.tables import table


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.6 FROM orders)")
def sub_scalar(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    mean = s.scalar(orders.agg((F.avg("o_totalprice") * 1.6).alias("mean")), "mean")
    return orders.join(F.broadcast(mean)).where("o_totalprice > mean").select("o_orderkey")  # one row


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer")
def sub_correlated_scalar(spark: SparkSession, sf: str) -> DataFrame:
    """Grouped once by the correlated key; a missing group counts 0."""
    grouped = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))
    joined = table(spark, sf, "customer").join(grouped, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "most")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)")
def sub_correlated_filter(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    means = items.groupBy("l_partkey").agg((0.2 * F.avg("l_quantity")).alias("least"))
    return items.join(means, "l_partkey").where("l_quantity < least").select("l_orderkey", "l_linenumber")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal < -950)")
def sub_exists(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").where("l_discount > 0.09")
    poor = table(spark, sf, "customer").where("c_acctbal < -950")
    kept = table(spark, sf, "supplier").join(items, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return kept.join(poor, F.col("c_nationkey") == F.col("s_nationkey"), "left_anti").select("s_suppkey")


@query("SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) IN (SELECT c_nationkey % 5, c_nationkey FROM customer WHERE c_acctbal > 9000)")
def sub_row_in(spark: SparkSession, sf: str) -> DataFrame:
    rich = table(spark, sf, "customer").where("c_acctbal > 9000").select((F.col("c_nationkey") % 5).alias("a"), F.col("c_nationkey").alias("b"))
    on = (F.col("n_regionkey") == F.col("a")) & (F.col("n_nationkey") == F.col("b"))
    return table(spark, sf, "nation").join(rich, on, "left_semi").select("n_nationkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice > ANY (SELECT l_extendedprice FROM lineitem WHERE l_linenumber = 7) AND p_size = ANY (SELECT s_nationkey FROM supplier)")
def sub_any(spark: SparkSession, sf: str) -> DataFrame:
    seventh = table(spark, sf, "lineitem").where("l_linenumber = 7")
    dear = s.quantified(table(spark, sf, "part"), "p_retailprice", ">", "ANY", seventh, "l_extendedprice")
    return s.quantified(dear, "p_size", "=", "ANY", table(spark, sf, "supplier"), "s_nationkey").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey < 5) AND c_nationkey <> ALL (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9500)")
def sub_all(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier")
    rich = s.quantified(table(spark, sf, "customer"), "c_acctbal", ">=", "ALL", suppliers.where("s_nationkey < 5"), "s_acctbal")
    return s.quantified(rich, "c_nationkey", "<>", "ALL", suppliers.where("s_acctbal > 9500"), "s_nationkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < ALL (SELECT s_acctbal FROM supplier WHERE s_suppkey < 0)")
def sub_all_of_nothing(spark: SparkSession, sf: str) -> DataFrame:
    none = table(spark, sf, "supplier").where("s_suppkey < 0")
    return s.quantified(table(spark, sf, "customer"), "c_acctbal", "<", "ALL", none, "s_acctbal").select("c_custkey")


@query("SELECT bucket, count(*) AS customers FROM (SELECT o_custkey, count(*) AS bucket FROM orders GROUP BY o_custkey) AS t(o_custkey, bucket) GROUP BY bucket")
def sub_derived(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("bucket"))
    return per.groupBy("bucket").agg(F.count("*").alias("customers"))


@query("""
    WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000),
         per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey)
    SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS n FROM per JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey
""")
def cte_chain(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").where("o_totalprice > 150000").select("o_custkey")
    per = big.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return per.join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("n"))


@query("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
def cte_recursive_union_all(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(
        "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t"
    )


@query("""
    WITH RECURSIVE reach(k) AS (
        SELECT 1 UNION SELECT CAST((k * 3 + e.s) % 25 AS INTEGER) FROM reach, (VALUES (1), (4)) AS e(s)
    ) SELECT n_name FROM reach JOIN nation ON n_nationkey = k
""")
def cte_recursive_union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    seed = spark.range(1).select(F.lit(1).alias("k"))
    edges = spark.createDataFrame([(1,), (4,)], "s int")

    def step(new: DataFrame) -> DataFrame:
        return new.join(F.broadcast(edges)).select(((F.col("k") * 3 + F.col("s")) % 25).alias("k"))  # two rows

    reach = s.recursive_distinct(seed, step)
    return reach.join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("k")).select("n_name")


@query("SELECT r_name, CAST(n AS BIGINT) AS n FROM (SELECT r_regionkey, r_name FROM region) r, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) t")
def lateral_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    grouped = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    joined = table(spark, sf, "region").join(grouped, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("r_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT n_name FROM nation WHERE n_regionkey = 2")
def view_expansion(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "nation").createOrReplaceTempView("nation_of_view")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW asian AS SELECT n_name FROM nation_of_view WHERE n_regionkey = 2")
    return spark.table("asian")
