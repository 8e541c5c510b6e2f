"""Query text, from parser to rows."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest

from tesserql.dialect import Dialect, DialectError, Unsupported
from tesserql.dialect.parser import parse
from tesserql.sources.tables import register
from tests.oracle import connection, plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db(spark):
    register(spark, SF)
    spark.createDataFrame([(1, "ann", 10, D("1.50")), (2, "Bob", None, D("2.25")), (3, "cy", 30, None)], "id int, name string, age int, score decimal(6,2)").createOrReplaceTempView("p")
    spark.createDataFrame([(1, 1, "red"), (2, 1, "Blue"), (3, 9, None)], "id int, p_id int, label string").createOrReplaceTempView("ch")
    return Dialect(spark)


VALUES = [
    ("1 + 1", 2), ("7 / 2", D("3.5000")), ("1 / 3", D("0.3333")), ("1 / 0", None), ("7 DIV 2", 3), ("-7 DIV 2", -3), ("7 % 0", None), ("-7 MOD 3", -1), ("1.5 * 2", D("3.0")), ("2 ^ 3", 1),
    ("'12abc' + 1", 13.0), ("'abc' = 0", 1), ("'10' = 10", 1), ("NULL <=> NULL", 1), ("1 <> 2", 1), ("1 XOR 1", 0), ("NOT 2", 0), ("!0", 1), ("2 AND 3", 1), ("NULL OR 1", 1), ("NULL AND 1", None),
    ("5 & 6", 4), ("5 | 2", 7), ("1 << 3", D(8)), ("~0", D("18446744073709551615")), ("x'4D'", b"M"), ("b'101'", 5), ("3 BETWEEN 1 AND 4", 1), ("3 NOT BETWEEN 1 AND 4", 0), ("2 IN (1, 2)", 1), ("'a' IN ('b')", 0),
    ("(1, 2) < (1, 3)", 1), ("(1, 2) = (1, 2)", 1), ("(1, 2) IN ((1, 2), (3, 4))", 1), ("NULL IS NULL", 1), ("0 IS FALSE", 1), ("NULL IS NOT TRUE", 1), ("'abc' LIKE 'a%'", 1), ("'a%c' LIKE 'a\\%c'", 1), ("'abc' NOT LIKE 'b_'", 1),
    ("'abc' REGEXP '^a'", 1), ("'abc' NOT REGEXP 'c$'", 0), ("CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END", "b"), ("CASE WHEN 0 THEN 1 ELSE 'x' END", "x"), ("IF(1 > 2, 'y', 'n')", "n"), ("IFNULL(NULL, 5)", 5), ("NULLIF(1, 1)", None),
    ("COALESCE(NULL, 1, 2.5)", D("1.0")), ("CAST('12abc' AS SIGNED)", 12), ("CAST(2.5 AS SIGNED)", 3), ("CAST('3.456' AS DECIMAL(5,2))", D("3.46")), ("CAST(-1 AS UNSIGNED)", D("18446744073709551615")), ("CAST(5 AS CHAR)", "5"), ("CAST('2024-02-30' AS DATE)", None),
    ("CONCAT('a', 1, 'b')", "a1b"), ("CONCAT_WS('-', 'a', NULL, 'b')", "a-b"), ("SUBSTRING('abcdef' FROM 2 FOR 3)", "bcd"), ("SUBSTR('abc', 0)", ""), ("TRIM(LEADING 'x' FROM 'xxax')", "ax"), ("TRIM('  a ')", "a"), ("LENGTH('é')", 2), ("CHAR_LENGTH('é')", 1),
    ("POSITION('b' IN 'abc')", 2), ("LOCATE('c', 'abcabc', 4)", 6), ("REPLACE('aXb', 'X', '-')", "a-b"), ("FIELD('b', 'a', 'b')", 2), ("ELT(2, 'a', 'b')", "b"), ("MAKE_SET(5, 'a', 'b', 'c')", "a,c"), ("FORMAT(1234.567, 2)", "1,234.57"), ("HEX(255)", "FF"), ("HEX('a')", "61"),
    ("LPAD('a', 3, '*')", "**a"), ("REPEAT('ab', 2)", "abab"), ("REVERSE('abc')", "cba"), ("SUBSTRING_INDEX('a.b.c', '.', 2)", "a.b"), ("SOUNDEX('Hello')", "H400"), ("INSERT('abcd', 2, 2, 'X')", "aXd"), ("STRCMP('a', 'b')", -1), ("CRC32('abc')", 891568578),
    ("ROUND(2.5)", D(3)), ("ROUND(2.5e0)", 2.0), ("ROUND(1.298, 1)", D("1.3")), ("TRUNCATE(1.999, 1)", D("1.9")), ("FLOOR(-1.5)", -2), ("CEIL(1.2)", 2), ("ABS(-3)", 3), ("SIGN(-2)", -1), ("GREATEST(1, 3, 2)", 3), ("LEAST(1, NULL)", None), ("MOD(7, 3)", 1), ("POW(2, 3)", 8.0),
    ("LOG(2, 8)", 3.0), ("SQRT(-1)", None), ("PI() > 3", 1), ("CONV('ff', 16, 10)", "255"), ("BIT_COUNT(7)", 3), ("INTERVAL(5, 1, 4, 9)", 2),
    ("DATE_ADD('2024-01-31', INTERVAL 1 MONTH)", date(2024, 2, 29)), ("DATE '2024-01-01' + INTERVAL 1 DAY", date(2024, 1, 2)), ("DATE_SUB('2024-01-01 00:00:00', INTERVAL 1 SECOND)", datetime(2023, 12, 31, 23, 59, 59)), ("INTERVAL 1 YEAR + DATE '2024-02-29'", date(2025, 2, 28)),
    ("DATEDIFF('2024-03-01', '2024-02-01')", 29), ("TIMESTAMPDIFF(MONTH, '2024-01-15', '2024-03-14')", 1), ("TIMESTAMPADD(HOUR, 2, '2024-01-01')", datetime(2024, 1, 1, 2)), ("EXTRACT(YEAR_MONTH FROM '2024-03-05')", 202403), ("DATE_FORMAT('2024-03-05 06:07:08', '%W %D %H:%i')", "Tuesday 5th 06:07"),
    ("STR_TO_DATE('5/3/2024', '%d/%m/%Y')", date(2024, 3, 5)), ("YEAR('2024-03-05')", 2024), ("WEEK('2008-02-20', 1)", 8), ("LAST_DAY('2024-02-01')", date(2024, 2, 29)), ("DAYNAME('2024-03-05')", "Tuesday"), ("MAKEDATE(2024, 60)", date(2024, 2, 29)), ("TO_DAYS('2007-10-07')", 733321), ("UNIX_TIMESTAMP('2015-11-13 10:20:19')", 1447410019),
    ("GET_FORMAT(DATE, 'EUR')", "%d.%m.%Y"), ("JSON_EXTRACT('{\"a\": [1, 2]}', '$.a[last]')", "2"), ("'{\"a\": \"x\"}' ->> '$.a'", "x"), ("JSON_ARRAY(1, 'a', NULL)", '[1, "a", null]'), ("JSON_OBJECT('k', 1)", '{"k": 1}'), ("JSON_LENGTH('[1,2]')", 2), ("JSON_VALID('{')", 0), ("JSON_CONTAINS('[1,2]', '2')", 1),
    ("2 MEMBER OF ('[1, 2]')", 1), ("JSON_TYPE('[]')", "ARRAY"), ("JSON_KEYS('{\"bb\": 1, \"a\": 2}')", '["a", "bb"]'), ("JSON_UNQUOTE('\"a\"')", "a"), ("JSON_DEPTH('[[1]]')", 3), ("JSON_OVERLAPS('[1]', '[1,2]')", 1), ("JSON_CONTAINS_PATH('{\"a\":1}', 'one', '$.a', '$.b')", 1), ("CAST('{\"a\":1}' AS JSON)", '{"a": 1}'),
    ("INET_ATON('10.0.5.9')", 167773449), ("INET6_NTOA(INET6_ATON('::1'))", "::1"), ("IS_IPV4('1.2.3.4')", 1), ("IS_IPV6('::1')", 1), ("BIN_TO_UUID(UUID_TO_BIN('6ccd780c-baba-1026-9564-5b8c656024db'))", "6ccd780c-baba-1026-9564-5b8c656024db"), ("REGEXP_REPLACE('a b', 'b', 'X')", "a X"), ("REGEXP_SUBSTR('abc def', '[a-z]+', 1, 2)", "def"),
    ("REGEXP_INSTR('dog cat', 'cat')", 5), ("@@version", "8.4.11"), ("'it''s' ' on'", "it's on"), ("\"q\"", "q"), ("-(-3)", 3), ("_utf8mb4'x'", "x"), ("'a' COLLATE utf8mb4_0900_ai_ci = 'A'", 1), ("TIME_FORMAT('2024-01-01 10:11:12', '%H')", "10"), ("QUOTE(NULL)", "NULL"), ("(SELECT 5)", 5), ("EXISTS (SELECT 1)", 1), ("3 > ANY (SELECT 2)", 1), ("3 > ALL (SELECT 5)", 0),
    ("2147483647 + 1", 2147483648), ("-2147483647 - 2", -2147483649), ("65536 * 65536", 4294967296), ("RAND(1)", 0.40540353712197724), ("RAND(NULL)", 0.15522042769493574),
]


def test_values(db):
    row = db.sql("SELECT " + ", ".join(f"{text} AS c{k}" for k, (text, _) in enumerate(VALUES))).first()
    wrong = []
    for k, (text, want) in enumerate(VALUES):
        got = bytes(row[k]) if isinstance(row[k], bytearray) else row[k]
        if got != want or (got is None) != (want is None):
            wrong.append((text, got, want))
    assert not wrong, wrong


ROWS = [
    ("SELECT id, name FROM p WHERE age > 5 ORDER BY id DESC", [(3, "cy"), (1, "ann")]),
    ("SELECT p.id, label FROM p LEFT JOIN ch ON ch.p_id = p.id ORDER BY p.id, label", [(1, "Blue"), (1, "red"), (2, None), (3, None)]),
    ("SELECT COUNT(*), COUNT(age), SUM(age), AVG(age) FROM p", [(3, 2, 40, D("20.0000"))]),
    ("SELECT p_id, GROUP_CONCAT(label ORDER BY label DESC SEPARATOR ';') g FROM ch GROUP BY p_id ORDER BY p_id", [(1, "red;Blue"), (9, None)]),
    ("SELECT p_id, COUNT(*) n FROM ch GROUP BY p_id WITH ROLLUP ORDER BY n, p_id", [(9, 1), (1, 2), (None, 3)]),
    ("SELECT id FROM p WHERE id NOT IN (SELECT p_id FROM ch)", [(2,), (3,)]),
    ("SELECT id FROM p WHERE EXISTS (SELECT 1 FROM ch WHERE ch.p_id = p.id)", [(1,)]),
    ("SELECT id, (SELECT COUNT(*) FROM ch WHERE ch.p_id = p.id) n FROM p ORDER BY 1", [(1, 2), (2, 0), (3, 0)]),
    ("WITH a AS (SELECT id FROM p), b(x) AS (SELECT id + 1 FROM a) SELECT x FROM b ORDER BY x LIMIT 1, 1", [(3,)]),
    ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 4) SELECT SUM(n) FROM t", [(10,)]),
    ("WITH RECURSIVE r(k) AS (SELECT 1 UNION SELECT (k * 2) % 7 FROM r), s AS (SELECT k + 10 AS t FROM r) SELECT t FROM s ORDER BY t", [(11,), (12,), (14,)]),
    ("(SELECT 1 x UNION SELECT 2) UNION ALL (SELECT 1) ORDER BY x", [(1,), (1,), (2,)]),
    ("SELECT id FROM p INTERSECT SELECT p_id FROM ch", [(1,)]),
    ("SELECT id, ROW_NUMBER() OVER (ORDER BY id DESC) r, SUM(id) OVER w s FROM p WINDOW w AS (ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) ORDER BY id", [(1, 3, 1), (2, 2, 3), (3, 1, 5)]),
    ("SELECT id, LAG(id) OVER (w ORDER BY id) b FROM p WINDOW w AS (PARTITION BY id > 1) ORDER BY id", [(1, None), (2, None), (3, 2)]),
    ("SELECT t.n FROM p, LATERAL (SELECT COUNT(*) n FROM ch WHERE ch.p_id = p.id) t ORDER BY n", [(0,), (0,), (2,)]),
    ("SELECT a.x FROM (SELECT 1 UNION ALL SELECT 2) AS a(x) WHERE a.x > 1", [(2,)]),
    ("VALUES ROW(1, 'a'), ROW(2, 'b')", [(1, "a"), (2, "b")]), ("TABLE ch LIMIT 0", []),
    ("SELECT STDDEV(id), VARIANCE(id), BIT_OR(id), BIT_AND(id) FROM p WHERE id > 99", [(None, None, D(0), D("18446744073709551615"))]),
    ("SELECT id FROM p USE INDEX (PRIMARY) WHERE name LIKE 'B%' OR score = '1.5' ORDER BY id", [(1,), (2,)]),
    ("SELECT DISTINCT p_id > 5 AS big FROM ch ORDER BY big", [(0,), (1,)]),
    ("SELECT id FROM p WHERE age >= ALL (SELECT age FROM p WHERE age IS NOT NULL) ", [(3,)]),
    ("SELECT MAX(score) / 2 FROM p", [(D("1.125000"),)]), ("SELECT JSON_ARRAYAGG(age) FROM p WHERE id = 2", [("[null]",)]),
    ("SELECT name FROM p NATURAL JOIN (SELECT 2 AS id) s", [("Bob",)]), ("SELECT * FROM p JOIN ch USING (id) WHERE id = 1", [(1, "ann", 10, D("1.50"), 1, "red")]),
    ("SELECT id FROM p HAVING id > 2", [(3,)]), ("SELECT 1 FROM DUAL WHERE 'abc'", []),
]


@pytest.mark.parametrize("text, want", ROWS, ids=[t[:60] for t, _ in ROWS])
def test_rows(db, text, want):
    got = [tuple(r) for r in db.sql(text).collect()]
    assert (got if "ORDER BY" in text else sorted(got, key=repr)) == want


SHARED = [
    "SELECT o_orderstatus, COUNT(*) AS n, MAX(o_totalprice) AS m FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus",
    "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey IN (1, 2, 3) AND o_orderpriority LIKE '1%'",
    "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)",
    "SELECT l_orderkey, l_linenumber, RANK() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS r FROM lineitem",
    "SELECT c_custkey FROM customer c WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer i WHERE i.c_nationkey = c.c_nationkey)",
]


@pytest.mark.parametrize("text", SHARED, ids=[t[:50] for t in SHARED])
def test_against_duckdb(db, text):
    ours = sorted(repr(tuple(plain(v) for v in r)) for r in db.sql(text).collect())
    theirs = sorted(repr(tuple(plain(v) for v in r)) for r in connection(SF).execute(text).fetchall())
    assert ours == theirs


def test_full_text(spark, db):
    from tesserql.operators import fulltext

    texts = ["The database engine stores rows", "engines and a database", None, "search the database engine", "nothing"]
    spark.createDataFrame(list(enumerate(texts)), "id int, body string").createOrReplaceTempView("notes")
    for words, mode, fn in (("database engine", "", fulltext.natural), ("+database -rows >search", " IN BOOLEAN MODE", fulltext.boolean), ("engin*", " IN BOOLEAN MODE", fulltext.boolean)):
        match = f"MATCH (body) AGAINST ('{words}'{mode})"
        got = {r.id: r.score for r in db.sql(f"SELECT id, {match} AS score FROM notes n WHERE {match} ORDER BY score DESC").collect()}
        want = {r.id: r.rank for r in fn(spark.table("notes"), "body", words).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), words


def test_parameters_and_variables(db):
    db.set("@least", 2)
    assert [r.id for r in db.sql("SELECT id FROM p WHERE id >= @least AND name <> ? ORDER BY id", "it's").collect()] == [2, 3]
    with pytest.raises(DialectError):
        db.sql("SELECT ?")


def test_default_collation_ignores_case(spark, db):
    loose = Dialect(spark, ignore_case=True)
    assert loose.sql("SELECT 'ABC' LIKE 'a%' AS x, 'ABC' REGEXP 'b' AS y").first() == (1, 1)


@pytest.mark.parametrize("text", ["SELECT", "SELECT 1 +", "SELECT (1", "FROM t", "SELECT 1 FROM t WHERE", "SELECT a FROM (SELECT 1)", "SELECT no_such(1)", "SELECT LEFT('a')", "SELECT 1 2"])
def test_refused_text(db, text):
    with pytest.raises(DialectError):
        db.sql(text)


@pytest.mark.parametrize("text", ["SELECT MATCH (name) AGAINST ('x' WITH QUERY EXPANSION) FROM p", "SELECT MATCH (name) AGAINST (name) FROM p", "SELECT * FROM JSON_TABLE('[]', '$' COLUMNS (a INT PATH '$')) t", "SELECT @x := 1", "SELECT 1 INTO @x", "SELECT SUM(DISTINCT id) OVER () FROM p", "SELECT * FROM information_schema.tables"])
def test_clauses_that_are_named_and_refused(db, text):
    with pytest.raises(Unsupported):
        db.sql(text)


def test_parse_precedence():
    assert repr(parse("SELECT 1 + 2 * 3").items[0].value) == repr(parse("SELECT 1 + (2 * 3)").items[0].value)
    assert repr(parse("SELECT NOT a = b OR c").items[0].value) == repr(parse("SELECT (NOT (a = b)) OR c").items[0].value)
