"""Sorting, limits, DISTINCT and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserql.queries.registry import query
from tesserql.sources.tables import table


@query("SELECT s_suppkey, s_nationkey, s_name FROM supplier ORDER BY CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey END NULLS FIRST, s_name DESC")
def sort_multi_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """NULLs come first, as ascending order has them by default."""
    key = F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey"))
    return table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_name").orderBy(key.asc(), F.desc("s_name"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_limit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 7 OFFSET 20")
def limit_offset(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").offset(20).limit(7)


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_brand", "p_size").distinct()


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return (
        table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")),
        table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).where("k < 18"),
    )


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_nationkey < 18"


@query(f"({_A}) UNION ALL ({_B})")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    return a.unionAll(b)


@query(f"({_A}) UNION ({_B})")
def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    return a.union(b).distinct()


@query(f"({_A}) INTERSECT ({_B})")
def intersect_distinct(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    return a.intersect(b)


@query(f"({_A}) INTERSECT ALL ({_B})")
def intersect_all(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    return a.intersectAll(b)


@query(f"({_A}) EXCEPT ({_B})")
def except_distinct(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    return a.subtract(b)


@query(f"({_A}) EXCEPT ALL ({_B})")
def except_all(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    return a.exceptAll(b)


@query("(SELECT n_name AS x FROM nation) UNION ((SELECT r_name AS x FROM region) INTERSECT (SELECT 'ASIA' AS x)) ORDER BY x DESC LIMIT 9")
def setop_nested_order(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("x"))
    regions = table(spark, sf, "region").select(F.col("r_name").alias("x"))
    asia = spark.range(1).select(F.lit("ASIA").alias("x"))
    return nations.union(regions.intersect(asia)).distinct().orderBy(F.desc("x")).limit(9)


@query("(SELECT CAST(r_regionkey AS VARCHAR) AS x FROM region) UNION ALL (SELECT r_name AS x FROM region)")
def setop_typing(spark: SparkSession, sf: str) -> DataFrame:
    """Branches of different types meet in a common one."""
    regions = table(spark, sf, "region")
    return regions.select(F.col("r_regionkey").cast("string").alias("x")).unionAll(regions.select(F.col("r_name").alias("x")))
