"""Scalar functions by their names in query text, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserql.queries.registry import query
from tesserql.queries.texts import run


@query("""
    SELECT c_custkey, upper(to_hex(c_custkey)) AS hexed, CASE WHEN c_custkey = 0 THEN '0' ELSE ltrim(bin(c_custkey), '0') END AS binned,
           upper(hex(c_mktsegment)) AS text_hex, c_mktsegment AS unhexed, rtrim(c_mktsegment || '  ') || '|' AS rtrimmed, 'x' || c_name || 'x' AS trimmed,
           'a' || repeat(' ', CAST(c_nationkey % 5 AS INTEGER)) || 'b' AS spaced, CAST(instr(c_name, '0') AS BIGINT) AS located,
           CAST(CASE WHEN instr(substr(c_name, 12), '1') > 0 THEN instr(substr(c_name, 12), '1') + 11 ELSE 0 END AS BIGINT) AS later,
           '''' || c_name || '''' AS quoted, CAST(unicode(c_mktsegment) AS BIGINT) AS ord, c_name AS from64,
           CAST(c_custkey % 2 = 1 AS INTEGER) AS odd
    FROM customer
""")
def text_strings(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, """
        SELECT c_custkey, HEX(c_custkey) AS hexed, BIN(c_custkey) AS binned, HEX(c_mktsegment) AS text_hex,
               CONVERT(UNHEX(HEX(c_mktsegment)) USING utf8mb4) AS unhexed, CONCAT(RTRIM(CONCAT(c_mktsegment, '  ')), '|') AS rtrimmed,
               CONCAT('x', TRIM(CONCAT('  ', c_name, ' ')), 'x') AS trimmed, CONCAT('a', SPACE(c_nationkey % 5), 'b') AS spaced,
               CAST(POSITION('0' IN c_name) AS SIGNED) AS located, CAST(LOCATE('1', c_name, 12) AS SIGNED) AS later,
               QUOTE(c_name) AS quoted, CAST(ORD(c_mktsegment) AS SIGNED) AS ord,
               CONVERT(FROM_BASE64(TO_BASE64(c_name)) USING utf8mb4) AS from64, CAST(c_custkey % 2 = 1 AS SIGNED) AS odd
        FROM customer
    """)


@query("""
    SELECT c_custkey, CASE WHEN c_custkey = 0 THEN '0' ELSE ltrim(printf('%o', c_custkey), '0') END AS octal, sha1(c_name) AS sha, sha1(c_name) AS sha1,
           array_to_string(list_transform(range(8), lambda k: CASE WHEN (c_nationkey >> CAST(k AS INTEGER)) & 1 = 1 THEN 'Y' ELSE 'N' END), ',') AS bits,
           chr(CAST(65 + c_nationkey AS INTEGER)) AS letter, upper(to_hex(c_custkey)) AS base16, format('{:,.2f}', round(c_acctbal, 2)) AS grouped
    FROM customer
""")
def text_encodings(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, """
        SELECT c_custkey, OCT(c_custkey) AS octal, SHA(c_name) AS sha, SHA1(c_name) AS sha1, EXPORT_SET(c_nationkey, 'Y', 'N', ',', 8) AS bits,
               CONVERT(CHAR(65 + c_nationkey) USING utf8mb4) AS letter, CONV(c_custkey, 10, 16) AS base16, FORMAT(c_acctbal, 2) AS grouped
        FROM customer
    """)


@query("""
    SELECT p_partkey, CAST(ceil(p_retailprice / 7) AS BIGINT) AS up, trunc(p_retailprice / 10) * 1.0 AS cut, round(pi() * p_size, 6) AS pies, round(ln(p_size) / ln(3), 9) AS log3,
           round(ln(p_size), 9) AS logged, round(atan2(p_size, 3), 9) AS angle, round(pow(p_size, 1.5), 6) AS powered, round(tan(p_size), 6) AS tangent,
           round(asin(p_size / 100), 9) AS arc, round(acos(p_size / 100), 9) AS other_arc, round(1 / tan(p_size), 6) AS cotangent,
           CASE WHEN p_size > 100 THEN 1 END AS none
    FROM part
""")
def text_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, """
        SELECT p_partkey, CAST(CEILING(p_retailprice / 7) AS SIGNED) AS up, TRUNCATE(p_retailprice / 10, 0) AS cut, ROUND(PI() * p_size, 6) AS pies,
               ROUND(LOG(3, p_size), 9) AS log3, ROUND(LOG(p_size), 9) AS logged, ROUND(ATAN2(p_size, 3), 9) AS angle, ROUND(POW(p_size, 1.5), 6) AS powered,
               ROUND(TAN(p_size), 6) AS tangent, ROUND(ASIN(p_size / 100), 9) AS arc, ROUND(ACOS(p_size / 100), 9) AS other_arc,
               ROUND(COT(p_size), 6) AS cotangent, CAST(IF(ASIN(p_size + 100) IS NULL, NULL, 1) AS SIGNED) AS none
        FROM part
    """)


@query("""
    SELECT doc_id, coalesce(lang, 'none') AS filled, coalesce(lang, source, 'neither') AS first, nullif(lang, 'en') AS not_en,
           CAST(CASE WHEN lang IS NULL THEN 1 ELSE 0 END AS BIGINT) AS isnull,
           CAST(CASE WHEN n_chars IS NULL THEN -1 WHEN n_chars < 100 THEN 0 WHEN n_chars < 1000 THEN 1 WHEN n_chars < 10000 THEN 2 ELSE 3 END AS BIGINT) AS size_class,
           CAST(CASE WHEN lang IS NOT DISTINCT FROM NULL THEN 1 ELSE 0 END AS BIGINT) AS same, CASE lang WHEN 'en' THEN 'E' WHEN 'de' THEN 'D' ELSE '?' END AS letter,
           CAST(-n_chars AS BIGINT) AS negative
    FROM documents
""")
def text_control(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, """
        SELECT doc_id, IFNULL(lang, 'none') AS filled, COALESCE(lang, source, 'neither') AS first, NULLIF(lang, 'en') AS not_en,
               CAST(ISNULL(lang) AS SIGNED) AS isnull, CAST(INTERVAL(n_chars, 100, 1000, 10000) AS SIGNED) AS size_class,
               CAST(lang <=> NULL AS SIGNED) AS same, CASE lang WHEN 'en' THEN 'E' WHEN 'de' THEN 'D' ELSE '?' END AS letter, CAST(-n_chars AS SIGNED) AS negative
        FROM documents
    """)


@query("""
    SELECT event_id, CAST(ts AS DATE) + 3 AS added, CAST(ts AS DATE) - 40 AS taken, CAST(ts AS DATE) AS day, CAST(day(ts) AS BIGINT) AS dom,
           CAST(epoch(date_trunc('second', ts)) + 62167219200 AS BIGINT) AS seconds, CAST(microsecond(ts) % 1000000 AS BIGINT) AS micro,
           ts + INTERVAL 90 MINUTE AS later, strftime(ts, '%H-%M') AS hm, CAST(ts AS DATE) AS back, strftime(ts, '%m.%d.%Y') AS usa,
           ts + INTERVAL 150 MINUTE AS shifted,
           CAST(year(ts + INTERVAL 5 MONTH) * 100 + month(ts + INTERVAL 5 MONTH) AS BIGINT) AS period,
           CAST((year(ts) - 2020) * 12 + month(ts) - 1 AS BIGINT) AS months
    FROM events
""")
def text_dates(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, """
        SELECT event_id, ADDDATE(DATE(ts), 3) AS added, SUBDATE(DATE(ts), INTERVAL 40 DAY) AS taken, DATE(ts) AS day, CAST(DAYOFMONTH(ts) AS SIGNED) AS dom,
               CAST(TO_SECONDS(ts) AS SIGNED) AS seconds, CAST(MICROSECOND(ts) AS SIGNED) AS micro, TIMESTAMPADD(MINUTE, 90, ts) AS later,
               TIME_FORMAT(TIME(ts), '%H-%i') AS hm, FROM_DAYS(TO_DAYS(ts)) AS back, DATE_FORMAT(ts, GET_FORMAT(DATE, 'USA')) AS usa,
               CONVERT_TZ(ts, '+00:00', '+02:30') AS shifted, CAST(PERIOD_ADD(DATE_FORMAT(ts, '%Y%m'), 5) AS SIGNED) AS period,
               CAST(PERIOD_DIFF(DATE_FORMAT(ts, '%Y%m'), 202001) AS SIGNED) AS months
        FROM events
    """)


@query("""
    SELECT l_orderkey, l_linenumber,
           CAST(CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) THEN 1 ELSE 0 END AS BIGINT) AS any_equal,
           CAST(CASE WHEN l_quantity > (SELECT max(p_size) FROM part) THEN 1 ELSE 0 END AS BIGINT) AS all_greater,
           CAST(CASE WHEN l_quantity > 5 THEN 1 END AS BIGINT) AS any_null, CAST(CASE WHEN l_quantity > 5 THEN NULL ELSE 0 END AS BIGINT) AS all_null,
           1 AS of_none
    FROM lineitem
""")
def text_quantified(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, """
        SELECT l_orderkey, l_linenumber, CAST(l_suppkey = ANY (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AS SIGNED) AS any_equal,
               CAST(l_quantity > ALL (SELECT p_size FROM part) AS SIGNED) AS all_greater,
               CAST(l_quantity > ANY (SELECT 5 UNION SELECT NULL) AS SIGNED) AS any_null,
               CAST(l_quantity > ALL (SELECT 5 UNION SELECT NULL) AS SIGNED) AS all_null,
               CAST(l_quantity > ALL (SELECT p_size FROM part WHERE p_size < 0) AS SIGNED) AS of_none
        FROM lineitem
    """)


@query("""
    SELECT c_custkey, '::ffff:10.0.0.' || (c_custkey % 256) AS mapped, CAST(1 AS BIGINT) AS is_mapped, CAST(0 AS BIGINT) AS is_compat, CAST(1 AS BIGINT) AS is_uuid,
           '00000000-0000-4000-8000-' || lpad(lower(to_hex(c_custkey)), 12, '0') AS uuid, 16 * 1 AS bytes
    FROM customer
""")
def text_network(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, """
        SELECT c_custkey, INET6_NTOA(INET6_ATON(CONCAT('::ffff:10.0.0.', c_custkey % 256))) AS mapped,
               CAST(IS_IPV4_MAPPED(INET6_ATON(CONCAT('::ffff:10.0.0.', c_custkey % 256))) AS SIGNED) AS is_mapped,
               CAST(IS_IPV4_COMPAT(INET6_ATON(CONCAT('::ffff:10.0.0.', c_custkey % 256))) AS SIGNED) AS is_compat,
               CAST(IS_UUID(CONCAT('00000000-0000-4000-8000-', LPAD(LOWER(HEX(c_custkey)), 12, '0'))) AS SIGNED) AS is_uuid,
               BIN_TO_UUID(UUID_TO_BIN(CONCAT('00000000-0000-4000-8000-', LPAD(LOWER(HEX(c_custkey)), 12, '0')))) AS uuid,
               LENGTH(UUID_TO_BIN(CONCAT('00000000-0000-4000-8000-', LPAD(LOWER(HEX(c_custkey)), 12, '0')))) AS bytes
        FROM customer
    """)


@query("""
    SELECT c_custkey, '[' || c_custkey || ', "' || c_mktsegment || '"]' AS pair, '{"key": ' || c_custkey || ', "segment": "' || c_mktsegment || '"}' AS member,
           CAST(c_custkey AS VARCHAR) AS extracted, c_mktsegment AS unquoted, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS BIGINT) AS contains,
           CAST(1 AS BIGINT) AS has_path, CAST(CASE WHEN c_nationkey IN (1, 2) THEN 1 ELSE 0 END AS BIGINT) AS overlaps, 'INTEGER' AS kind,
           CAST(2 AS BIGINT) AS length, CAST(2 AS BIGINT) AS depth, '["key", "segment"]' AS keys, CAST(1 AS BIGINT) AS valid,
           CAST(CASE WHEN c_nationkey IN (3, 4) THEN 1 ELSE 0 END AS BIGINT) AS held
    FROM customer
""")
def text_json(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, """
        SELECT c_custkey, CAST(JSON_ARRAY(c_custkey, c_mktsegment) AS CHAR) AS pair, CAST(doc AS CHAR) AS member, CAST(JSON_EXTRACT(doc, '$.key') AS CHAR) AS extracted,
               JSON_UNQUOTE(JSON_EXTRACT(doc, '$.segment')) AS unquoted, CAST(JSON_CONTAINS(doc, '"BUILDING"', '$.segment') AS SIGNED) AS contains,
               CAST(JSON_CONTAINS_PATH(doc, 'one', '$.key', '$.none') AS SIGNED) AS has_path, CAST(JSON_OVERLAPS('[1, 2]', JSON_ARRAY(c_nationkey)) AS SIGNED) AS overlaps,
               JSON_TYPE(JSON_EXTRACT(doc, '$.key')) AS kind, CAST(JSON_LENGTH(doc) AS SIGNED) AS length, CAST(JSON_DEPTH(doc) AS SIGNED) AS depth,
               CAST(JSON_KEYS(doc) AS CHAR) AS `keys`, CAST(JSON_VALID(doc) AS SIGNED) AS valid, CAST(c_nationkey MEMBER OF ('[3, 4]') AS SIGNED) AS held
        FROM (SELECT c_custkey, c_nationkey, c_mktsegment, JSON_OBJECT('key', c_custkey, 'segment', c_mktsegment) AS doc FROM customer) t
    """)


@query("""
    SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS secs, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS plus,
           strftime(ts - INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') AS minus, '24:00:00' AS gap, '01:02:03' AS made, '01:01:01' AS of_seconds
    FROM events
""")
def text_times(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, """
        SELECT event_id, CAST(TIME_TO_SEC(TIME(ts)) AS SIGNED) AS secs, DATE_FORMAT(ADDTIME(ts, '01:00:00'), '%Y-%m-%d %H:%i:%s') AS plus,
               DATE_FORMAT(SUBTIME(ts, '00:01:30'), '%Y-%m-%d %H:%i:%s') AS minus, TIME_FORMAT(TIMEDIFF(TIMESTAMPADD(DAY, 1, ts), ts), '%H:%i:%s') AS gap,
               TIME_FORMAT(MAKETIME(1, 2, 3), '%H:%i:%s') AS made, TIME_FORMAT(SEC_TO_TIME(3661), '%H:%i:%s') AS of_seconds
        FROM events
    """)


@query("""
    SELECT r_regionkey, 1 AS now_is_date, 1 AS utc_is_now, 1 AS same_user, 'utf8mb4' AS charset, 1 AS connected, CAST(8 AS BIGINT) AS bytes
    FROM region
""")
def text_session(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, """
        SELECT r_regionkey, CAST(CURDATE() = DATE(NOW()) AND CURRENT_DATE() = CURDATE() AND DATE(LOCALTIME()) = DATE(CURRENT_TIMESTAMP()) AS SIGNED) AS now_is_date,
               CAST(DATE(UTC_TIMESTAMP()) = UTC_DATE() AND SYSDATE() >= LOCALTIMESTAMP() AND CURTIME() = CURRENT_TIME() AS SIGNED) AS utc_is_now,
               CAST(USER() = CURRENT_USER() AND SESSION_USER() = SYSTEM_USER() AND LENGTH(VERSION()) > 0 AND SCHEMA() <=> DATABASE() AS SIGNED) AS same_user,
               CHARSET(r_name) AS charset, CAST(CONNECTION_ID() > 0 AS SIGNED) AS connected, CAST(LENGTH(RANDOM_BYTES(8)) AS SIGNED) AS bytes
        FROM region
    """)


@query("""
    SELECT c_custkey, round(((a * 3 + b) % 1073741823) / 1073741823.0::DOUBLE, 12) AS drawn, CAST(c_nationkey AS BIGINT) * 1000000000 AS wide,
           c_custkey + 9007199254740993 AS far
    FROM (SELECT *, ((c_custkey * 65537 + 55555555) & 4294967295) % 1073741823 AS a, ((c_custkey * 268435457) & 4294967295) % 1073741823 AS b FROM customer)
""")
def text_random(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, """
        SELECT c_custkey, ROUND(RAND(c_custkey), 12) AS drawn, c_nationkey * 1000000000 AS wide, c_custkey + 9007199254740993 AS far FROM customer
    """)
