"""Aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserql.operators import aggregates as a
from tesserql.queries.registry import query
from tesserql.sources.tables import table


@query("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty,
           round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("count_order"),
    )


@query("SELECT count(*) AS n, count(l_quantity) AS known, round(sum(l_quantity), 2) AS total, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem")
def agg_global(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").agg(
        a.count().alias("n"), a.count("l_quantity").alias("known"), F.round(F.sum(q), 2).alias("total"), F.min(q).alias("least"), F.max(q).alias("most")
    )


@query("SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total, max(o_custkey) AS most FROM orders WHERE o_custkey < 0")
def agg_empty_input(spark: SparkSession, sf: str) -> DataFrame:
    none = table(spark, sf, "orders").where("o_custkey < 0")
    return none.agg(a.count().alias("n"), a.sum_exact("o_custkey").cast("bigint").alias("total"), F.max("o_custkey").alias("most"))


@query("SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY o_custkey")
def agg_group(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), a.sum_exact("o_orderkey").cast("bigint").alias("keys"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS y, upper(o_orderstatus) AS s, count(*) AS n FROM orders GROUP BY 1, 2")
def agg_group_by_expression(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), F.upper("o_orderstatus").alias("s")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000")
def agg_having(spark: SparkSession, sf: str) -> DataFrame:
    out = a.having(
        table(spark, sf, "orders"), ["o_custkey"], (F.col("n") > 12) & (F.col("most") > 100000), F.count("*").alias("n"), F.max("o_totalprice").alias("most")
    )
    return out.select("o_custkey", "n")


@query("""
    SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS numbers,
           round(CAST(avg(DISTINCT l_linenumber) AS DOUBLE), 4) AS mean, min(DISTINCT l_tax) AS least
    FROM lineitem GROUP BY l_returnflag
""")
def agg_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        a.count_distinct("l_suppkey").alias("suppliers"), a.sum_exact("l_linenumber", distinct=True).cast("bigint").alias("numbers"),
        F.round(a.avg_exact("l_linenumber", distinct=True).cast("double"), 4).alias("mean"), F.min("l_tax").alias("least"),
    )


@query("""
    SELECT l_returnflag, count(DISTINCT (l_linestatus, flag)) FILTER (WHERE flag IS NOT NULL) AS pairs
    FROM (SELECT *, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS flag FROM lineitem) GROUP BY l_returnflag
""")
def agg_count_distinct_multi(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("flag", F.expr("CASE WHEN l_linenumber > 2 THEN l_linenumber END"))
    return rows.groupBy("l_returnflag").agg(a.count_distinct("l_linestatus", "flag").alias("pairs"))


@query("""
    SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INTEGER) AS grouping_l_returnflag,
           CAST(grouping(l_linestatus) AS INTEGER) AS grouping_l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
def agg_rollup_grouping(spark: SparkSession, sf: str) -> DataFrame:
    return a.rollup(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")
    )


@query("""
    SELECT o_custkey, left(string_agg(CAST(o_orderkey AS VARCHAR), ';' ORDER BY o_totalprice, o_orderkey), 1024) AS orders_by_price,
           string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses
    FROM orders GROUP BY o_custkey
""")
def agg_group_concat(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    by_price = a.concat_groups(orders, ["o_custkey"], "o_orderkey", ["o_totalprice", "o_orderkey"], ";", name="orders_by_price")
    statuses = a.concat_groups(orders, ["o_custkey"], "o_orderstatus", distinct=True, name="statuses")
    return by_price.join(statuses.withColumnRenamed("o_custkey", "k"), F.col("o_custkey").eqNullSafe(F.col("k"))).drop("k")


@query("""
    SELECT l_linenumber, round(stddev_pop(l_quantity), 6) AS std, round(stddev_samp(l_quantity), 6) AS std_samp,
           round(var_pop(l_quantity), 5) AS variance, round(var_samp(l_quantity), 5) AS var_samp
    FROM lineitem GROUP BY l_linenumber
""")
def agg_stat_pop_samp(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(
        F.round(a.std("l_quantity"), 6).alias("std"), F.round(a.stddev_samp("l_quantity"), 6).alias("std_samp"),
        F.round(a.variance("l_quantity"), 5).alias("variance"), F.round(a.var_samp("l_quantity"), 5).alias("var_samp"),
    )


@query("""
    SELECT o_orderstatus, bit_and(o_orderkey | 1) AS bits_and, bit_or(o_orderkey) AS bits_or, bit_xor(o_orderkey) AS bits_xor
    FROM orders GROUP BY o_orderstatus
""")
def agg_bit(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        a.bit_and(key.bitwiseOR(F.lit(1))).cast("bigint").alias("bits_and"), a.bit_or(key).cast("bigint").alias("bits_or"), a.bit_xor(key).cast("bigint").alias("bits_xor")
    )


@query("SELECT n_regionkey, '[' || string_agg(coalesce(CAST(k AS VARCHAR), 'null'), ',' ORDER BY n_nationkey) || ']' AS listed FROM (SELECT *, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey END AS k FROM nation) GROUP BY n_regionkey")
def agg_json_array(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").withColumn("k", F.expr("CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey END"))
    return rows.groupBy("n_regionkey").agg(a.json_arrayagg("k", ["n_nationkey"]).alias("listed"))


@query("SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_name) || '}' AS members FROM nation GROUP BY n_regionkey")
def agg_json_object(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(a.json_objectagg("n_name", "n_nationkey").alias("members"))


@query("SELECT n_regionkey, count(*) AS n, max(r_name) AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
def agg_any_value(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.any_value("r_name").alias("r_name"))


@query("SELECT event_type, round(sum(value), 4) AS value FROM events GROUP BY event_type")
def agg_salted(spark: SparkSession, sf: str) -> DataFrame:
    # few keys, all of them hot: sums are combined before the shuffle, so that no salt is needed
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("value"))


@query("SELECT CAST(round(sum(l_extendedprice * l_discount), 2) AS DOUBLE) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.04 AND 0.08 AND l_quantity < 24")
def agg_filtered_revenue(spark: SparkSession, sf: str) -> DataFrame:
    kept = table(spark, sf, "lineitem").where(F.col("l_discount").between(0.04, 0.08) & (F.col("l_quantity") < 24))
    return kept.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))
