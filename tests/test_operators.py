"""Operators beyond what the oracle queries show."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserql.operators import aggregates, dml, fulltext, joins, subqueries
from tesserql.plans import sizes
from tesserql.sources import catalog, tables
from tesserql.streaming import events

TEXTS = [
    "The database engine stores rows; the engine reads rows.", "Row engines and databases", None, "", "a database of databases",
    "full text search in a database engine", "Search engines: full-text search!", "engine", "nothing here", "stop the engine, start the search",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, body string")


def words_of(text):
    found = re.findall(r"[^\W]+", (text or "").lower())
    return [w for w in found if 3 <= len(w) <= 84 and w not in fulltext.STOP_WORDS]


def idf(test):
    n = sum(1 for t in TEXTS if test(words_of(t)))
    return 0.0 if n == 0 else math.log10(1.0001) if n == len(TEXTS) else math.log10(len(TEXTS) / n)


def ranks(df):
    return {r.id: r.rank for r in df.collect()}


def test_natural_ranking(docs):
    for query in ("database engine", "search search full", "the of", "unknown", "ENGINE"):
        asked = words_of(query)
        want = {}
        for i, t in enumerate(TEXTS):
            tf = Counter(words_of(t))
            if any(tf[w] for w in asked):
                want[i] = sum(tf[w] * idf(lambda ws, w=w: w in ws) ** 2 for w in asked)
        got = ranks(fulltext.natural(docs, "body", query))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_boolean_ranking(docs):
    def keys(query):
        return sorted(ranks(fulltext.boolean(docs, "body", query)))

    def held(test):
        return sorted(i for i, t in enumerate(TEXTS) if test(words_of(t)))

    assert keys("+engine -rows") == held(lambda w: "engine" in w and "rows" not in w)
    assert keys("database search") == held(lambda w: "database" in w or "search" in w)
    assert keys("data*") == held(lambda w: any(x.startswith("data") for x in w))
    assert keys('"full text"') == held(lambda w: any(a == ("full", "text") for a in zip(w, w[1:])))
    assert keys("+engine +(rows search)") == held(lambda w: "engine" in w and ("rows" in w or "search" in w))
    plain, more, less = (ranks(fulltext.boolean(docs, "body", f"{o}engine")) for o in ("", ">", "<"))
    assert all(abs(more[k] - plain[k] - 1) < 1e-9 and abs(less[k] - plain[k] + 1) < 1e-9 for k in plain)
    for bad in ("(a", "a)", "a @"):
        with pytest.raises(ValueError):
            fulltext.parse_boolean(bad)


def test_quantified_comparisons_with_nulls(spark):
    left = spark.createDataFrame([(1,), (3,), (5,), (None,)], "x int")
    for values in ([], [3], [2, 4], [3, None], [None], [5, 5]):
        sub = spark.createDataFrame([(v,) for v in values], "y int")
        for op in ("=", "<>", "<", "<=", ">", ">="):
            for quantifier in ("ANY", "ALL"):
                got = sorted((r.x is None, r.x or 0) for r in subqueries.quantified(left, "x", op, quantifier, sub, "y").collect())
                want = []
                for x in (1, 3, 5, None):
                    test = [None if x is None or y is None else eval(f"{x} {dict([('=', '=='), ('<>', '!=')]).get(op, op)} {y}") for y in values]
                    true = any(t is True for t in test) if quantifier == "ANY" else all(t is True for t in test)
                    if true:
                        want.append((x is None, x or 0))
                assert got == sorted(want), (values, op, quantifier)


def test_scalar_subquery(spark):
    assert subqueries.scalar(spark.range(0), "id").first().id is None
    assert subqueries.scalar(spark.range(1), "id").first().id == 0
    with pytest.raises(Exception, match="more than 1 row"):
        subqueries.scalar(spark.range(2), "id").collect()


def test_recursion(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4)]
    frame = spark.createDataFrame(edges, "a int, b int")
    seed = spark.createDataFrame([(1,)], "a int")
    reach = subqueries.recursive_distinct(seed, lambda new: new.join(frame, "a").select(F.col("b").alias("a")))
    assert sorted(r.a for r in reach.collect()) == [1, 2, 3, 4]
    with pytest.raises(RecursionError):
        subqueries.recursive_all(seed, lambda new: new, depth=3)


def test_joins(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(-50, 50)) for i in range(200)]
    ranges = [(i, x, x + rng.uniform(-1, 20)) for i in range(60) for x in [rng.uniform(-50, 50)]]
    p, q = spark.createDataFrame(points, "i int, x double"), spark.createDataFrame(ranges, "k int, low double, high double")
    got = sorted((r.i, r.k) for r in joins.range_join(p, "x", q, "low", "high", 5.0).collect())
    assert got == sorted((i, k) for i, x in points for k, a, b in ranges if a <= x <= b)
    wide = [(i, x, x + rng.choice([0, 0.1, 3, 40, 5000, 1e12, math.inf])) for i in range(40) for x in [rng.uniform(-50, 50)]]
    wide += [(40, -math.inf, 3.0), (41, -math.inf, math.inf), (42, 5.0, -math.inf)]
    points += [(200, None), (201, points[0][1]), (201, points[0][1])]
    p, q = spark.createDataFrame(points, "i int, x double"), spark.createDataFrame(wide, "k int, low double, high double")
    pairs = [(i, k) for i, x in points for k, a, b in wide if x is not None and a <= x <= b]
    for how in ("inner", "left"):
        got = [(r.i, r.k) for r in joins.range_join(p, "x", q, "low", "high", 0.5, how).collect()]
        met = {i for i, _ in pairs}
        assert sorted(map(repr, got)) == sorted(map(repr, pairs + [(i, None) for i, _ in points if how == "left" and i not in met]))
    assert sorted(r.i for r in joins.range_join(p, "x", q, "low", "high", 0.5, "left_semi").collect()) == sorted(i for i, _ in points if i in met)
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (3, "y")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(repr, a.join(b, "k", how).collect()))
        assert sorted(map(repr, joins.salted(a, b, "k", 4, how).collect())) == plain
    with pytest.raises(ValueError):
        joins.salted(a, b, "k", 4, "full")
    assert joins.natural(a, b.withColumnRenamed("k", "z")).count() == 8
    plan = sizes.operators(joins.not_in(a, "k", b, "k"))
    assert plan  # a null-aware broadcast is not among them
    assert "null-aware" not in sizes.explain(joins.not_in(a, "k", b, "k"))


def test_aggregates_of_nothing_and_cut(spark):
    none = spark.range(0)
    row = none.agg(
        aggregates.bit_and("id").alias("a"), aggregates.bit_or("id").alias("o"), aggregates.bit_xor("id").alias("x"), aggregates.group_concat("id").alias("g"),
        aggregates.json_arrayagg("id").alias("j"),
    ).first()
    assert (str(row.a), int(row.o), int(row.x), row.g, row.j) == ("18446744073709551615", 0, 0, None, None)
    long = spark.range(600).agg(aggregates.group_concat("id", ["id"]).alias("g"), aggregates.group_concat(F.lit("é"), most=5).alias("e")).first()
    assert len(long.g) == 1024 and long.e == "é,é"
    assert aggregates.rollup(none, ["id"], F.count("*").alias("n")).collect() == []
    both = spark.createDataFrame([("k", 1), ("k", 2), ("a", None)], "k string, v int")
    assert both.agg(aggregates.json_objectagg("k", "v").alias("o")).first().o in ('{"a":null,"k":2}', '{"k":2}')
    with pytest.raises(Exception, match="NULL member names"):
        spark.createDataFrame([(None, 1)], "k string, v int").agg(aggregates.json_objectagg("k", "v")).collect()


def test_concatenation_of_large_groups(spark):
    rng = random.Random(4)
    texts = ["", "a", "bb", "é" * 5, "x" * 2000, None, "same"]
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice(texts[:4] if i % 50 else texts), rng.choice([None, 1, 2, 3])) for i in range(900)]
    rows += [(1, "same", 0)] * 3000 + [(3, None, 1)] * 3 + [(4, "", 1)] * 2 + [(5, "y" * 1024, 1)]
    df = spark.createDataFrame(rows, "k int, t string, o int")
    for separator in (",", "", ", "):
        for order, distinct in ((["o"], False), ([], False), ([], True)):
            for most in (1024, 7):
                want = df.groupBy("k").agg(aggregates.group_concat("t", [*order, "t"] if order else [], separator, distinct, most).alias("g"))
                for salts in (1, 3):
                    got = aggregates.concat_groups(df, ["k"], "t", order, separator, distinct, most, "g", salts)
                    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), (separator, order, distinct, most, salts)


def test_writes(spark):
    t = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    rows = spark.createDataFrame([(2, 5), (2, 7), (3, 1)], "k int, v int")
    up = dml.upsert(t, rows, ["k"], {"v": F.col("old.v") + F.col("new.v")})
    assert sorted((r.k, r.v) for r in up.collect()) == [(1, 10), (2, 27), (3, 1)]
    assert sorted((r.k, r.v) for r in dml.replace(t, rows, ["k"]).collect()) == [(1, 10), (2, 7), (3, 1)]
    assert sorted((r.k, r.v) for r in dml.update(t, {"k": F.col("k") + 1, "v": F.col("k")}).collect()) == [(2, 2), (3, 3)]
    unknown = spark.createDataFrame([(1, None), (2, 3)], "k int, v int")
    assert [r.k for r in dml.delete(unknown, F.col("v") > 1).collect()] == [1]
    child = spark.createDataFrame([(7, 1), (8, 2), (9, None), (10, 99)], "c int, p int")
    assert [r.c for r in dml.foreign_key_violations(child, "p", t, "k").collect()] == [10]
    parents, children = dml.delete_parents(t, child, F.col("k") == 1, "p", "k", "CASCADE")
    assert (sorted(r.k for r in parents.collect()), sorted(r.c for r in children.collect())) == ([2], [8, 9, 10])
    parents, _ = dml.delete_parents(t, child, F.col("k") == 1, "p", "k", "RESTRICT")
    assert sorted(r.k for r in parents.collect()) == [1, 2]
    with pytest.raises(ValueError):
        dml.insert(t, rows.select("k"))


def test_sources_and_catalog(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb"), (2, None)], "k int, v string")
    path = f"file://{tmp_path}/out"
    tables.write_delimited(df, path)
    assert sorted(tables.read_delimited(spark, path, "k int, v string").collect()) == sorted(df.collect())
    tables.create_as(df, "made_from_query")
    tables.create_like(spark, "made_like", "made_from_query")
    assert spark.table("made_like").columns == ["k", "v"] and spark.table("made_like").count() == 0
    assert {r.table_name for r in catalog.tables(spark).collect()} >= {"made_from_query", "made_like"}
    assert [r.Field for r in catalog.describe(df).collect()] == ["k", "v"]
    assert catalog.create_table(df, "t") == "CREATE TABLE `t` (\n  `k` int,\n  `v` varchar\n)"
    assert catalog.schemata(spark).count() >= 1 and catalog.engines(spark).count() == 2
    keys = {"t": {"PRIMARY": ["k"], "uk_v": ["v"], "by": ["v", "k"]}}
    foreign = {"t": {"fk": ("v", "p", "id", "CASCADE")}}
    assert catalog.statistics(spark, keys).count() == 4 and catalog.referential_constraints(spark, foreign).count() == 1
    assert catalog.table_constraints(spark, keys, foreign, {"t": {"c": "k > 0"}}).count() == 4
    assert catalog.key_column_usage(spark, keys, foreign).count() == 3
    assert list(tables.rows(df.orderBy("k")))[0].k == 1
    spark.sql("DROP TABLE made_from_query")
    spark.sql("DROP TABLE made_like")


def test_plans_push_filters_and_prune_columns(spark):
    items = tables.table(spark, "/root/testdata/sf0.001", "lineitem")
    kept = items.where("l_quantity > 10").select("l_orderkey")
    assert "GreaterThan(l_quantity,10.0)" in sizes.pushed_filters(kept)[0]
    assert sizes.read_columns(kept) == ["l_orderkey:bigint,l_quantity:double"]
    assert sizes.estimated_bytes(items) > 0 and sizes.broadcast_if_small(items, 1) is items


def test_stream_of_events(spark, tmp_path):
    source = tables.table(spark, "/root/testdata/sf0.001", "events").repartition(2)
    folder = f"file://{tmp_path}/in"
    source.write.parquet(folder)
    streamed = events.stream(spark, folder, source.schema)
    running = (
        events.tumbling(streamed).writeStream.format("memory").queryName("rolled").outputMode("complete")
        .option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    )
    running.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.table("rolled").collect()}
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r.start, r.event_type): r.n for r in events.tumbling(source).collect()}
    assert got == want


def test_inner_names_do_not_touch_the_users_columns(spark):
    names = ["_n", "_null", "_other", "_bin", "_point_bin", "_rank", "_salt", "_min", "_max", "_known", "_tf", "_low", "_idf2", "_place"]
    extra = ", ".join(f"{k} AS `{c}`" for k, c in enumerate(names))
    rows = spark.sql(f"SELECT x, CONCAT('apple ', x) AS text, {extra} FROM VALUES (1), (2), (3) AS v(x)")
    other = spark.sql("SELECT * FROM VALUES (2), (3) AS v(y)")
    kept = [{c: k for k, c in enumerate(names)}] * 3

    def users(df):
        assert set(names) <= set(df.columns) and not [c for c in df.columns if c.startswith("_") and c not in names]
        return [{c: r[c] for c in names} for r in df.collect()]

    assert users(joins.not_in(rows, "x", other, "y")) == kept[:1]
    ranges = spark.sql("SELECT 1.0 AS low, 2.0 AS high")
    assert users(joins.range_join(rows, "x", ranges, "low", "high", 1.0)) == kept[:2]
    assert users(joins.salted(rows, other.withColumnRenamed("y", "x"), "x", 2)) == kept[:2]
    tops = joins.lateral_top(other.withColumnRenamed("y", "x"), rows, "x", [F.col("x")], 1)
    assert users(tops) == kept[:2]
    for op, which, n in ((">", "ANY", 1), (">=", "ALL", 1), ("=", "ANY", 2), ("<>", "ALL", 1)):
        assert users(subqueries.quantified(rows, "x", op, which, other, "y")) == kept[:n]
    assert users(fulltext.natural(rows, "text", "apple")) == kept
    assert users(fulltext.boolean(rows, "text", "+apple")) == kept
    assert users(fulltext.top_per(rows, "text", "x", "x", 1)) == kept
