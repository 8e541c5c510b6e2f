"""Scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserql.functions import control, core
from tesserql.functions import json as j
from tesserql.functions import network as n
from tesserql.functions import numeric as m
from tesserql.functions import regex as r
from tesserql.functions import strings as s
from tesserql.functions import temporal as t
from tesserql.queries.registry import query
from tesserql.sources.tables import table

L = F.lit


@query("""
    SELECT c_custkey, c_name || '/' || c_mktsegment AS concat, concat_ws('-', c_mktsegment, NULL, CAST(c_nationkey AS VARCHAR)) AS concat_ws,
           CAST(strlen(c_name) AS INTEGER) AS bytes, CAST(length(c_name) AS INTEGER) AS chars, CAST(8 * strlen(c_name) AS INTEGER) AS bits,
           lower(c_mktsegment) AS low, upper(c_name) AS up, reverse(c_name) AS rev, repeat('ab', c_nationkey % 4) AS rep,
           replace(c_name, 'Customer', 'C') AS replaced
    FROM customer
""")
def str_basics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey", s.concat("c_name", L("/"), "c_mktsegment").alias("concat"),
        s.concat_ws(L("-"), "c_mktsegment", L(None), "c_nationkey").alias("concat_ws"),
        s.length("c_name").alias("bytes"), s.char_length("c_name").alias("chars"), s.bit_length("c_name").alias("bits"),
        s.lower("c_mktsegment").alias("low"), s.upper("c_name").alias("up"), s.reverse("c_name").alias("rev"),
        s.repeat(L("ab"), F.col("c_nationkey") % 4).alias("rep"), s.replace("c_name", L("Customer"), L("C")).alias("replaced"),
    )


@query("""
    SELECT c_custkey, substr(c_name, 5, 3) AS sub, CASE WHEN length(c_name) >= 4 THEN right(c_name, 4) ELSE '' END AS from_end,
           left(c_name, 3) AS lft, right(c_name, 2) AS rgt, lpad(c_mktsegment, 12, '*') AS lpad, rpad(c_mktsegment, 4, '*') AS rpad,
           ltrim('  ' || c_mktsegment) AS ltrim, CAST(instr(c_name, '0') AS INTEGER) AS instr, split_part(c_name, '#', 1) AS before_hash,
           CASE WHEN c_name < 'Customer#000000500' THEN -1 WHEN c_name = 'Customer#000000500' THEN 0 ELSE 1 END AS strcmp,
           'X' || substr(c_name, 4) AS inserted
    FROM customer
""")
def str_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey", s.substring("c_name", L(5), L(3)).alias("sub"), s.substring("c_name", L(-4)).alias("from_end"),
        s.left("c_name", L(3)).alias("lft"), s.right("c_name", L(2)).alias("rgt"), s.lpad("c_mktsegment", L(12), L("*")).alias("lpad"),
        s.rpad("c_mktsegment", L(4), L("*")).alias("rpad"), s.ltrim(s.concat(L("  "), "c_mktsegment")).alias("ltrim"),
        s.instr("c_name", L("0")).alias("instr"), s.substring_index("c_name", "#", 1).alias("before_hash"),
        s.strcmp("c_name", L("Customer#000000500")).alias("strcmp"), s.insert("c_name", L(1), L(3), L("X")).alias("inserted"),
    )


@query("""
    SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS INTEGER) AS field,
           CASE c_nationkey % 4 WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS elt,
           array_to_string(list_filter([CASE WHEN c_custkey & 1 <> 0 THEN 'a' END, CASE WHEN c_custkey & 2 <> 0 THEN 'b' END, CASE WHEN c_custkey & 4 <> 0 THEN 'c' END], lambda x: x IS NOT NULL), ',') AS make_set,
           CAST(CASE c_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS find_in_set,
           CAST(CASE WHEN c_acctbal >= 5000 THEN 2 WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS INTEGER) AS interval_place
    FROM customer
""")
def str_lists(spark: SparkSession, sf: str) -> DataFrame:
    rest = F.col("c_nationkey") % 3
    return table(spark, sf, "customer").select(
        "c_custkey", s.field("c_mktsegment", L("BUILDING"), L("MACHINERY")).alias("field"),
        s.elt(F.col("c_nationkey") % 4, L("one"), L("two")).alias("elt"), s.make_set("c_custkey", L("a"), L("b"), L("c")).alias("make_set"),
        s.find_in_set(rest, L("0,1")).alias("find_in_set"), control.interval("c_acctbal", 0.0, 5000.0).alias("interval_place"),
    )


@query("""
    SELECT o_orderkey, hex(o_orderkey) AS hexed, CASE WHEN o_orderkey = 0 THEN '0' ELSE ltrim(bin(o_orderkey), '0') END AS binary_digits,
           ascii(substr(o_orderpriority, 1, 1)) AS ascii, base64(encode(o_orderstatus)) AS b64, hex(encode(o_orderstatus)) AS hex_text
    FROM orders
""")
def str_encodings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey", s.hex_number("o_orderkey").alias("hexed"), s.bin_("o_orderkey").alias("binary_digits"), s.ascii_("o_orderpriority").alias("ascii"),
        s.to_base64("o_orderstatus").alias("b64"), s.hex_text("o_orderstatus").alias("hex_text"),
    )


@query("SELECT c_custkey, md5(c_name) AS md5, sha1(c_name) AS sha1, sha256(c_name) AS sha2 FROM customer")
def hash_functions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", s.md5("c_name").alias("md5"), s.sha1("c_name").alias("sha1"), s.sha2("c_name", 256).alias("sha2"))


@query("""
    SELECT l_orderkey, l_linenumber,
           CAST(CASE WHEN l_linenumber - 3 = 0 THEN NULL ELSE (CASE WHEN (l_orderkey * 10000 / 1.0) / (l_linenumber - 3) < 0 THEN -1 ELSE 1 END)
                * ((2 * l_orderkey * 10000 + abs(l_linenumber - 3)) // (2 * abs(l_linenumber - 3))) END AS BIGINT) AS quotient_in_ten_thousandths,
           CASE WHEN l_linenumber - 3 = 0 THEN NULL ELSE l_orderkey % (l_linenumber - 3) END AS modulo,
           CASE WHEN l_linenumber - 3 = 0 THEN NULL ELSE CAST(sign(l_linenumber - 3) AS BIGINT) * (l_orderkey // abs(l_linenumber - 3)) END AS int_quotient
    FROM lineitem
""")
def num_division(spark: SparkSession, sf: str) -> DataFrame:
    return _divided(table(spark, sf, "lineitem"))


def _divided(items: DataFrame) -> DataFrame:
    d = F.col("l_linenumber") - 3
    return items.select(
        "l_orderkey", "l_linenumber", (m.divide("l_orderkey", d) * 10000).cast("bigint").alias("quotient_in_ten_thousandths"),
        m.mod("l_orderkey", d).cast("bigint").alias("modulo"), m.div("l_orderkey", d).alias("int_quotient"),
    )


@query("""
    SELECT c_custkey, abs(c_acctbal) AS abs, CAST(floor(c_acctbal) AS BIGINT) AS floor, CAST(ceil(c_acctbal) AS BIGINT) AS ceil,
           CAST(round(CAST(c_acctbal AS DECIMAL(18,2)), 1) AS DOUBLE) AS rounded, CAST(sign(c_acctbal) AS BIGINT) AS sign,
           CAST(trunc(c_acctbal) AS DOUBLE) AS truncated, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE greatest(c_acctbal, 100.0) END AS most,
           CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE least(c_acctbal, 100.0) END AS least
    FROM customer
""")
def num_rounding(spark: SparkSession, sf: str) -> DataFrame:
    sometimes = F.when(F.col("c_custkey") % 5 != 0, 100.0)
    return table(spark, sf, "customer").select(
        "c_custkey", m.abs_("c_acctbal").alias("abs"), m.floor_("c_acctbal").alias("floor"), m.ceil_("c_acctbal").alias("ceil"),
        m.round_(F.col("c_acctbal").cast("decimal(18,2)"), 1).cast("double").alias("rounded"), m.sign("c_acctbal").alias("sign"),
        m.truncate_double("c_acctbal", 0).alias("truncated"), m.greatest("c_acctbal", sometimes).alias("most"), m.least("c_acctbal", sometimes).alias("least"),
    )


@query("""
    SELECT p_partkey, round(sqrt(p_size), 8) AS sqrt, round(exp(p_size / 50.0), 8) AS exp, round(ln(p_size), 8) AS ln, round(log10(p_size), 8) AS log10,
           round(log2(p_size), 8) AS log2, round(pow(p_size, 2), 6) AS pow, round(sin(p_size), 8) AS sin, round(cos(p_size), 8) AS cos, round(atan(p_size), 8) AS atan,
           round(degrees(p_size), 6) AS degrees, round(radians(p_size), 8) AS radians, CASE WHEN p_size > 25 THEN round(ln(p_size - 25), 8) END AS guarded
    FROM part
""")
def num_math(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("p_size")
    named = {
        "sqrt": m.sqrt(x), "exp": m.exp(x / 50.0), "ln": m.ln(x), "log10": m.log10(x), "log2": m.log2(x), "sin": m.sin(x), "cos": m.cos(x), "atan": m.atan(x),
        "radians": m.radians(x), "guarded": m.ln(x - 25),
    }
    return table(spark, sf, "part").select(
        "p_partkey", *[F.round(c, 8).alias(k) for k, c in named.items()], F.round(m.power(x, 2), 6).alias("pow"), F.round(m.degrees(x), 6).alias("degrees")
    )


@query("""
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(month(o_orderdate) AS INTEGER) AS mo, CAST(day(o_orderdate) AS INTEGER) AS d,
           CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS wd,
           CAST(weekofyear(o_orderdate) AS INTEGER) AS week3, CAST((dayofyear(o_orderdate) + 6 - dayofweek(o_orderdate)) // 7 AS INTEGER) AS week0,
           CAST(yearweek(o_orderdate) AS INTEGER) AS yw3, dayname(o_orderdate) AS day_name, monthname(o_orderdate) AS month_name, last_day(o_orderdate) AS last_day,
           CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719528 AS INTEGER) AS to_days
    FROM orders
""")
def date_parts(spark: SparkSession, sf: str) -> DataFrame:
    d = "o_orderdate"
    return table(spark, sf, "orders").select(
        "o_orderkey", t.year(d).alias("y"), t.quarter(d).alias("q"), t.month(d).alias("mo"), t.day(d).alias("d"), t.dayofyear(d).alias("doy"),
        t.dayofweek(d).alias("dow"), t.weekday(d).alias("wd"), t.week(d, 3).alias("week3"), t.week(d, 0).alias("week0"), t.yearweek(d, 3).alias("yw3"),
        t.dayname(d).alias("day_name"), t.monthname(d).alias("month_name"), t.last_day(d).alias("last_day"), t.to_days(d).alias("to_days"),
    )


@query("""
    SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS plus_month, CAST(CAST(o_orderdate AS DATE) - INTERVAL 10 DAY AS DATE) AS minus_days,
           CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 MINUTE AS plus_minutes, CAST(CAST(o_orderdate AS DATE) + INTERVAL 14 MONTH AS DATE) AS plus_year_month,
           CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-01') AS INTEGER) AS datediff,
           date_sub('month', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP), TIMESTAMP '1998-12-01') AS months,
           CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS year_month, make_date(CAST(year(o_orderdate) AS INTEGER), 1, 1) + 31 AS makedate
    FROM orders
""")
def date_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    when = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select(
        "o_orderkey", t.date_add(day, 1, "MONTH").alias("plus_month"), t.date_sub(day, 10, "DAY").alias("minus_days"), t.date_add(when, 90, "MINUTE").cast("timestamp_ntz").alias("plus_minutes"),
        t.date_add(day, L("1-2"), "YEAR_MONTH").alias("plus_year_month"), t.datediff(L("1998-12-01"), day).alias("datediff"),
        t.timestampdiff("MONTH", day, L("1998-12-01")).alias("months"), t.extract("YEAR_MONTH", day).alias("year_month"), t.makedate(F.year(day), L(32)).alias("makedate"),
    )


@query("""
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS plain, strftime(ts, '%d.%m.%y') AS short, strftime(ts, '%A %B') AS names, CAST(hour(ts) AS INTEGER) AS h,
           CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS se, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS secs,
           CAST(floor(epoch(ts)) AS BIGINT) AS unix, CAST(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)) AT TIME ZONE 'UTC' AS TIMESTAMP) AS back,
           CAST(strptime(strftime(ts, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS parsed
    FROM events
""")
def date_formats(spark: SparkSession, sf: str) -> DataFrame:
    x = "ts"
    return table(spark, sf, "events").select(
        "event_id", t.date_format(x, "%Y-%m-%d %H:%i:%s").alias("plain"), t.date_format(x, "%d.%m.%y").alias("short"), t.date_format(x, "%W %M").alias("names"), t.hour(x).alias("h"),
        t.minute(x).alias("mi"), t.second(x).alias("se"), t.time_to_sec(x).alias("secs"), t.unix_timestamp(x).alias("unix"), t.from_unixtime(t.unix_timestamp(x)).cast("timestamp_ntz").alias("back"),
        t.str_to_date(t.date_format(x, "%d/%m/%Y"), "%d/%m/%Y").alias("parsed"),
    )


@query("""
    SELECT event_id, json_extract_string(props, '$.' || k) AS by_path, CAST(json_valid(props) AS INTEGER) AS valid,
           json_type(props) AS kind, CAST(len(json_keys(props)) AS INTEGER) AS n
    FROM (SELECT *, json_keys(props)[1] AS k FROM events)
""")
def json_documents(spark: SparkSession, sf: str) -> DataFrame:
    first = F.get(F.json_object_keys("props"), L(0))
    rows = table(spark, sf, "events").withColumn("path", F.concat(L("$."), first))
    return rows.select(
        "event_id", F.expr("get_json_object(props, path)").alias("by_path"), j.valid("props").alias("valid"), j.type_("props").alias("kind"), j.length("props").alias("n")
    )


@query("""
    SELECT n_nationkey, '[' || n_nationkey || ', "' || n_name || '", null]' AS arr, '{"k": ' || n_regionkey || ', "name": "' || n_name || '"}' AS obj, CAST(n_regionkey IN (1, 3) AS INTEGER) AS member,
           n_name AS unquoted, 3 AS depth
    FROM nation
""")
def json_building(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        "n_nationkey", j.array("n_nationkey", "n_name", L(None)).alias("arr"), j.object_(("name", "n_name"), ("k", "n_regionkey")).alias("obj"),
        j.member_of("n_regionkey", L("[1, 3]")).alias("member"), j.extract_text(j.object_(("a", "n_name")), "$.a").alias("unquoted"), j.depth_(L('{"a": [1]}')).alias("depth"),
    )


@query("""
    SELECT p_partkey, CAST(regexp_matches(p_type, '(?i)^s') AS INTEGER) AS likes, coalesce(nullif(regexp_extract(p_name, '[0-9]+'), ''), NULL) AS digits,
           regexp_replace(p_name, '[0-9]', '#', 'g') AS masked, CAST(instr(p_brand, '#') AS INTEGER) AS place
    FROM part
""")
def regex_functions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", r.regexp_like("p_type", "^s", "i").alias("likes"), r.regexp_substr("p_name", "[0-9]+").alias("digits"),
        r.regexp_replace("p_name", "[0-9]", "#").alias("masked"), r.regexp_instr("p_brand", "#").alias("place"),
    )


@query("""
    SELECT s_suppkey, CAST(167772160 + s_suppkey AS BIGINT) AS aton, '10.0.' || (s_suppkey // 256) || '.' || (s_suppkey % 256) AS ntoa, 1 AS v4, 0 AS v6
    FROM supplier
""")
def net_addresses(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    address = F.concat(L("10.0."), F.floor(k / 256).cast("string"), L("."), (k % 256).cast("string"))
    return table(spark, sf, "supplier").select(
        "s_suppkey", n.inet_aton(address).alias("aton"), n.inet_ntoa(k + 167772160).alias("ntoa"), n.is_ipv4(address).alias("v4"), n.is_ipv6(address).alias("v6")
    )


@query("""
    SELECT c_custkey, coalesce(TRY_CAST(regexp_extract(x, '^[0-9]+') AS DOUBLE), 0) AS as_number, coalesce(TRY_CAST(regexp_extract(x, '^[0-9]+') AS BIGINT), 0) AS as_integer,
           CAST(c_acctbal AS VARCHAR) IS NOT NULL AS as_text, CAST(CAST(c_acctbal AS DECIMAL(12,1)) AS DOUBLE) AS as_decimal
    FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) || 'abc' ELSE 'x' || c_custkey END AS x FROM customer)
""")
def cast_coercion(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_custkey").cast("string"), L("abc"))).otherwise(F.concat(L("x"), F.col("c_custkey").cast("string")))
    rows = table(spark, sf, "customer").withColumn("x", x)
    return rows.select(
        "c_custkey", core.number_of("x").alias("as_number"), core.integer_of("x").alias("as_integer"), F.col("c_acctbal").cast("string").isNotNull().alias("as_text"),
        F.col("c_acctbal").cast("decimal(12,2)").cast("decimal(12,1)").cast("double").alias("as_decimal"),
    )


@query("SELECT lower(c_mktsegment) AS k, count(*) AS n FROM customer GROUP BY 1")
def collation_grouping(spark: SparkSession, sf: str) -> DataFrame:
    """Groups by a collation that ignores case, named by its lower form."""
    mixed = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.upper("c_mktsegment"))
    grouped = table(spark, sf, "customer").select(s.folded(mixed).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return grouped.select(F.lower(F.collate("c", "UTF8_BINARY")).alias("k"), "n")
