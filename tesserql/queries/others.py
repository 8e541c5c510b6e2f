"""Full text, writes, constraints, catalog and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserql.operators import dml, fulltext
from tesserql.queries.registry import query
from tesserql.sources import catalog
from tesserql.sources.tables import NAMES, table
from tesserql.streaming import events

_STOP = ", ".join(f"'{w}'" for w in sorted(fulltext.STOP_WORDS))
_WORDS = f"""
    w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents),
    held AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE length(word) BETWEEN 3 AND 84 AND word NOT IN ({_STOP}) GROUP BY ALL),
    total AS (SELECT count(*) AS rows FROM documents),
    idf AS (SELECT word, CASE WHEN count(*) >= max(rows) THEN log10(1.0001) ELSE log10(max(rows) / count(*)) END AS idf FROM held, total GROUP BY word)
"""


@query(f"""
    WITH {_WORDS}
    SELECT doc_id, round(sum(tf * idf * idf), 6) AS rank FROM held JOIN idf USING (word) WHERE word IN ('license', 'version', 'reserved') GROUP BY doc_id
""")
def ft_natural_rank(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ranked = fulltext.natural(docs, "text", "License version the reserved")
    return ranked.select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"""
    WITH {_WORDS}, score AS (
        SELECT doc_id, max(CASE WHEN word = 'license' THEN tf * idf * idf END) AS a, max(CASE WHEN word = 'version' THEN tf * idf * idf + 1 END) AS b,
               count(*) FILTER (WHERE word = 'apache') AS never, count(*) FILTER (WHERE word = 'license') AS must
        FROM held JOIN idf USING (word) GROUP BY doc_id
    ) SELECT doc_id, round(a + coalesce(b, 0), 6) AS rank FROM score WHERE must > 0 AND never = 0
""")
def ft_boolean(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ranked = fulltext.boolean(docs, "text", "+license >version -apache")
    return ranked.select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"""
    WITH {_WORDS}
    SELECT doc_id, round(sum(tf * idf * idf), 6) AS rank FROM held JOIN idf USING (word) WHERE word IN ('rights', 'public') GROUP BY doc_id ORDER BY sum(tf * idf * idf) DESC, doc_id LIMIT 10
""")
def ft_top(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    best = fulltext.top(fulltext.natural(docs, "text", "public rights"), "rank", "doc_id", 10)
    return best.select("doc_id", F.round("rank", 6).alias("rank"))


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey + 1000000, c_name FROM customer WHERE c_acctbal > 9000")
def dml_insert_select(spark: SparkSession, sf: str) -> DataFrame:
    target = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    rows = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_custkey") + 1000000, "c_name")
    return dml.insert(target, rows)


_SEGMENTS = "SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 = 0"
_NEW = "SELECT c_custkey AS k, 1.5 AS v FROM customer WHERE c_custkey % 2 = 0"


def _upsert_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return rows.where("k % 3 = 0"), rows.where("k % 2 = 0").withColumn("v", F.lit(1.5))


@query(f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN b.v WHEN b.k IS NULL THEN a.v ELSE a.v + b.v END AS v FROM ({_SEGMENTS}) a FULL JOIN ({_NEW}) b ON a.k = b.k")
def dml_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _upsert_sides(spark, sf)
    return dml.upsert(old, new, ["k"], {"v": F.col("old.v") + F.col("new.v")})


@query(f"SELECT k, v FROM ({_NEW}) UNION ALL SELECT k, v FROM ({_SEGMENTS}) WHERE k % 2 <> 0")
def dml_replace(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _upsert_sides(spark, sf)
    return dml.replace(old, new, ["k"])


@query(f"SELECT k, v FROM ({_SEGMENTS}) UNION ALL SELECT k, v FROM ({_NEW}) WHERE k % 3 <> 0")
def dml_insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _upsert_sides(spark, sf)
    return dml.insert_ignore(old, new, ["k"])


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer")
def dml_update(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return dml.update(rows, {"c_acctbal": F.col("c_acctbal") * 2}, F.col("c_nationkey") == 3).drop("c_nationkey")


@query("SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def dml_update_join(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), "o_totalprice")
    building = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    return dml.update_join(orders, building, ["k"], {"o_totalprice": F.lit(0.0)}).drop("k")


@query("SELECT p_partkey FROM part WHERE NOT (p_size < 10)")
def dml_delete(spark: SparkSession, sf: str) -> DataFrame:
    return dml.delete(table(spark, sf, "part"), F.col("p_size") < 10).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def dml_delete_join(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    gone = table(spark, sf, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("k"))
    return dml.delete_join(orders, gone, ["k"]).drop("k")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_discount < 0.1 AND l_quantity <= 50)")
def check_constraint(spark: SparkSession, sf: str) -> DataFrame:
    bad = dml.check_violations(table(spark, sf, "lineitem"), (F.col("l_discount") < 0.1) & (F.col("l_quantity") <= 50))
    return bad.select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def foreign_key_check(spark: SparkSession, sf: str) -> DataFrame:
    return dml.foreign_key_violations(table(spark, sf, "events"), "user_id", table(spark, sf, "customer"), "c_custkey").select("event_id")


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def unique_check(spark: SparkSession, sf: str) -> DataFrame:
    return dml.unique_violations(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"])


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def foreign_key_set_null(spark: SparkSession, sf: str) -> DataFrame:
    poor = F.col("c_acctbal") < 0
    _, children = dml.delete_parents(table(spark, sf, "customer"), table(spark, sf, "orders"), poor, "o_custkey", "c_custkey", "SET NULL")
    return children.select("o_orderkey", "o_custkey")


@query()
def info_schema_columns(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.columns(spark, {name: table(spark, sf, name) for name in NAMES})


@query()
def show_variables(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.variables(spark, "spark.sql.%")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: the same frame serves streams."""
    out = events.tumbling(table(spark, sf, "events"))
    return out.select("start", "event_type", "n", F.round("total", 6).alias("total"))


@query("""
    WITH marked AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
         numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked)
    SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, user_id, count(*) AS n FROM numbered GROUP BY user_id, session
""")
def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return events.sessions(table(spark, sf, "events"))
