"""Scans, projections and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserql.functions import control, core
from tesserql.functions import strings as s
from tesserql.queries.registry import query
from tesserql.sources.tables import dual, table, values


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_project(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 100 AND 2000 AND l_quantity > 10")
def filter_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").where(F.col("l_orderkey").between(100, 2000) & (F.col("l_quantity") > 10))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where("c_custkey = 42").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
def filter_in(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders")
    kept = rows.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("F"))
    return kept.select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 1000 AND 1100 OR p_size NOT BETWEEN 5 AND 45")
def filter_between(spark: SparkSession, sf: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf, "part").where(price.between(1000, 1100) | ~size.between(5, 45)).select("p_partkey", "p_retailprice")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1%' AND p_type NOT LIKE 'S%'")
def filter_like(spark: SparkSession, sf: str) -> DataFrame:
    kept = table(spark, sf, "part").where(F.col("p_name").like("%1%") & ~F.col("p_type").like("S%"))
    return kept.select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%customer#%9'")
def filter_like_ignore_case(spark: SparkSession, sf: str) -> DataFrame:
    kept = table(spark, sf, "customer").where(s.like("c_name", "%CUSTOMER#%9", ignore_case=True) == 1)
    return kept.select("c_custkey", "c_name")


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '[13]$') AND NOT regexp_matches(p_type, '^P')")
def filter_regexp(spark: SparkSession, sf: str) -> DataFrame:
    kept = table(spark, sf, "part").where(F.col("p_brand").rlike("[13]$") & ~F.col("p_type").rlike("^P"))
    return kept.select("p_partkey", "p_brand")


_NULLED = "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END"


@query(f"""
    SELECT c_custkey, CAST(x IS NULL AS INTEGER) AS is_null, CAST((x > 0) IS TRUE AS INTEGER) AS is_true,
           CAST((x > 0) IS NOT TRUE AS INTEGER) AS not_true, CAST((x > 0) IS NULL AS INTEGER) AS is_unknown,
           CAST(x IS NOT DISTINCT FROM NULL AS INTEGER) AS same_as_null
    FROM (SELECT c_custkey, {_NULLED} AS x FROM customer)
""")
def filter_null_tests(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(_NULLED).alias("x"))
    positive = F.col("x") > 0
    return rows.select(
        "c_custkey",
        control.isnull("x").alias("is_null"),
        core.flag(F.coalesce(positive, F.lit(False))).alias("is_true"),
        core.flag(~F.coalesce(positive, F.lit(False))).alias("not_true"),
        core.flag(positive.isNull()).alias("is_unknown"),
        core.flag(F.col("x").eqNullSafe(F.lit(None))).alias("same_as_null"),
    )


@query("SELECT p_partkey FROM part WHERE (p_size > 25) <> (p_retailprice > 1200)")
def filter_xor(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(core.xor(F.col("p_size") > 25, F.col("p_retailprice") > 1200)).select("p_partkey")


@query("""
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS simple_case,
           CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' END AS searched_case,
           CASE WHEN o_custkey % 2 <> 0 THEN 'odd' ELSE 'even' END AS if_value,
           coalesce(nullif(o_orderstatus, 'O'), 'was O') AS coalesced
    FROM orders
""")
def case_if_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(status == "F", "finished").when(status == "O", "open").otherwise("other").alias("simple_case"),
        F.when(price > 200000, "big").when(price > 100000, "mid").alias("searched_case"),
        control.if_number(F.col("o_custkey") % 2, F.lit("odd"), F.lit("even")).alias("if_value"),
        control.coalesce(control.nullif("o_orderstatus", F.lit("O")), F.lit("was O")).alias("coalesced"),
    )


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', CAST(2.5 AS DOUBLE)), (2, 'b', NULL), (3, NULL, 0.5)) AS t(column_0, column_1, column_2)")
def values_constructor(spark: SparkSession, sf: str) -> DataFrame:
    return values(spark, [(1, "a", 2.5), (2, "b", None), (3, None, 0.5)])


@query("SELECT 1 + 1 AS two, 'x' AS x")
def select_without_from(spark: SparkSession, sf: str) -> DataFrame:
    return dual(spark).select((F.lit(1) + F.lit(1)).alias("two"), F.lit("x").alias("x"))


@query("SELECT r_regionkey, r_name FROM region")
def table_statement(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity, l_linenumber) < (20, 3)")
def row_comparison(spark: SparkSession, sf: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, sf, "lineitem").where((q < 20) | ((q == 20) & (n < 3))).select("l_orderkey", "l_linenumber")


@query("SELECT s_suppkey FROM supplier WHERE (s_nationkey, s_suppkey % 5) IN ((1, 1), (2, 3), (7, 0))")
def row_in_list(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.struct(F.col("s_nationkey").cast("bigint").alias("a"), (F.col("s_suppkey") % 5).alias("b"))
    options = [F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in ((1, 1), (2, 3), (7, 0))]
    return table(spark, sf, "supplier").where(pair.isin(*options)).select("s_suppkey")


@query("""
    SELECT l_orderkey, l_linenumber, l_orderkey & 12 AS bit_and, l_orderkey | 1 AS bit_or, xor(l_orderkey, 255) AS bit_xor,
           l_orderkey << 3 AS shift_left, l_orderkey >> 2 AS shift_right,
           CAST(bit_count(l_orderkey) AS INTEGER) AS bits
    FROM lineitem
""")
def bit_operators(spark: SparkSession, sf: str) -> DataFrame:
    return _bits(table(spark, sf, "lineitem"))


def _bits(items: DataFrame) -> DataFrame:
    from tesserql.functions import numeric as m

    return items.select(
        "l_orderkey", "l_linenumber",
        m.bit_and("l_orderkey", 12).alias("bit_and"), m.bit_or("l_orderkey", 1).alias("bit_or"), m.bit_xor("l_orderkey", 255).alias("bit_xor"),
        m.shift_left("l_orderkey", 3).cast("bigint").alias("shift_left"), m.shift_right("l_orderkey", 2).cast("bigint").alias("shift_right"),
        m.bit_count("l_orderkey").cast("int").alias("bits"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000")
def parameters(spark: SparkSession, sf: str) -> DataFrame:
    """Placeholders, bound by position."""
    return spark.sql(
        "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = :customer AND o_totalprice > :least",
        args={"customer": 7, "least": 1000}, orders=table(spark, sf, "orders"),
    )
