"""Query text of the dialect, run through its front end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserql.dialect import Dialect
from tesserql.queries.registry import query
from tesserql.sources.tables import register


def run(spark: SparkSession, sf: str, text: str) -> DataFrame:
    register(spark, sf)
    return Dialect(spark).sql(text)


@query("""
    SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders
    WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1995-01-01' GROUP BY o_orderpriority HAVING count(*) > 1
""")
def text_grouping(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, """
        SELECT o_orderpriority, COUNT(*) AS n, ROUND(AVG(o_totalprice), 4) AS mean FROM orders
        WHERE o_orderdate >= '1994-01-01' AND o_orderdate < DATE '1994-01-01' + INTERVAL 1 YEAR GROUP BY 1 HAVING n > 1
    """)


@query("""
    SELECT c_custkey, n_name, CAST(n AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t ON o_custkey = c_custkey WHERE n_name LIKE '%A%'
""")
def text_joins(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, """
        SELECT c_custkey, n_name, n FROM customer INNER JOIN nation ON c_nationkey = n_nationkey
        LEFT OUTER JOIN (SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey) AS t (o_custkey, n) ON o_custkey = c_custkey WHERE n_name LIKE '%A%'
    """)


@query("""
    SELECT s_suppkey, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS place,
           (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 40) AS big FROM supplier
""")
def text_windows_subqueries(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, """
        SELECT s_suppkey, CAST(RANK() OVER w AS SIGNED) AS place, (SELECT COUNT(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 40) AS big
        FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)
    """)


@query("""
    WITH RECURSIVE d(k) AS (SELECT 0 UNION ALL SELECT k + 1 FROM d WHERE k < 9)
    SELECT k, (SELECT count(*) FROM part WHERE p_size % 10 = k) AS parts FROM d
""")
def text_recursive(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, """
        WITH RECURSIVE d (k) AS (SELECT 0 UNION ALL SELECT k + 1 FROM d WHERE k < 9)
        SELECT k, (SELECT COUNT(*) FROM part WHERE p_size MOD 10 = k) AS parts FROM d
    """)


@query("""
    SELECT c_custkey, upper(left(c_name, 4)) || '/' || c_mktsegment AS tag, CASE WHEN c_acctbal < 0 THEN 'owes' ELSE 'has' END AS state,
           strftime(DATE '2024-01-31' + CAST(c_custkey AS INTEGER), '%d.%m.%Y') AS due, CAST(c_custkey // 7 AS BIGINT) AS week
    FROM customer
""")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, """
        SELECT c_custkey, CONCAT(UPPER(LEFT(c_name, 4)), '/', c_mktsegment) AS tag, IF(c_acctbal < 0, 'owes', 'has') AS state,
               DATE_FORMAT(DATE '2024-01-31' + INTERVAL c_custkey DAY, '%d.%m.%Y') AS due, c_custkey DIV 7 AS week
        FROM customer
    """)
