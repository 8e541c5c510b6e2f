"""Definitions, writes, constraints and transactions by text."""

from decimal import Decimal as D

import pytest

from tesserql.dialect import ConstraintError, Database, DialectError, Unsupported


@pytest.fixture
def db(spark):
    out = Database(spark)
    out.execute("CREATE TABLE pa (id INT AUTO_INCREMENT PRIMARY KEY, name VARCHAR(12) NOT NULL, amt DECIMAL(6,2) DEFAULT 1.5, UNIQUE KEY uk_name (name), CHECK (amt >= 0)) ENGINE=InnoDB")
    out.execute("CREATE TABLE kid (id INT PRIMARY KEY, pa_id INT, twice INT AS (id * 2), KEY (pa_id), CONSTRAINT fk FOREIGN KEY (pa_id) REFERENCES pa (id) ON DELETE CASCADE)")
    assert out.execute("INSERT INTO pa (name) VALUES ('ann'), ('Bob')") == 2
    assert out.execute("INSERT INTO pa VALUES (7, 'cy', DEFAULT), (NULL, 'dee', 2.25)") == 2
    assert out.execute("INSERT INTO kid (id, pa_id) VALUES (1, 1), (2, 1), (3, 7), (4, NULL)") == 4
    return out


def rows(db, text, *parameters):
    return [tuple(r) for r in db.execute(text, *parameters).collect()]


def test_inserts(db):
    assert rows(db, "SELECT * FROM pa ORDER BY id") == [(1, "ann", D("1.50")), (2, "Bob", D("1.50")), (7, "cy", D("1.50")), (8, "dee", D("2.25"))]
    assert rows(db, "SELECT twice FROM kid ORDER BY id") == [(2,), (4,), (6,), (8,)]
    assert db.execute("INSERT IGNORE INTO pa (id, name) VALUES (1, 'zz'), (9, 'new'), (9, 'newer')") == 1
    assert db.execute("INSERT INTO pa (name) SELECT CONCAT('s', id) FROM kid WHERE id < 3") == 2
    assert rows(db, "SELECT id FROM pa WHERE name LIKE 's_' ORDER BY id") == [(10,), (11,)]
    db.execute("INSERT INTO kid (id, pa_id) SELECT id + 100, pa_id FROM kid WHERE pa_id = 7")
    assert rows(db, "SELECT id FROM kid WHERE pa_id = 7 ORDER BY id") == [(3,), (103,)]
    db.execute("INSERT INTO kid SET id = 50, pa_id = 2")
    db.execute("INSERT INTO kid (id, pa_id) VALUES (50, 1), (51, 1) ON DUPLICATE KEY UPDATE pa_id = VALUES(pa_id) + 1")
    assert rows(db, "SELECT id, pa_id FROM kid WHERE id IN (50, 51) ORDER BY id") == [(50, 2), (51, 1)]
    db.execute("REPLACE INTO kid (id, pa_id) VALUES (50, NULL)")
    assert rows(db, "SELECT pa_id FROM kid WHERE id = 50") == [(None,)]


def test_updates_and_deletes(db):
    assert db.execute("UPDATE pa SET amt = amt * 2, name = CONCAT(name, amt) WHERE id < 3") == 2
    assert rows(db, "SELECT name, amt FROM pa WHERE id < 3 ORDER BY id") == [("ann3.00", D("3.00")), ("Bob3.00", D("3.00"))]
    assert db.execute("UPDATE pa SET amt = 9 ORDER BY id DESC LIMIT 1") == 1
    assert rows(db, "SELECT id FROM pa WHERE amt = 9") == [(8,)]
    assert db.execute("UPDATE pa JOIN kid ON kid.pa_id = pa.id SET pa.amt = kid.id + 10 WHERE kid.id = 3") == 1
    assert rows(db, "SELECT amt FROM pa WHERE id = 7") == [(D("13.00"),)]
    assert db.execute("DELETE FROM pa WHERE id = 1") == 1  # carried to its children
    assert rows(db, "SELECT id FROM kid ORDER BY id") == [(3,), (4,)]
    assert db.execute("DELETE kid FROM kid JOIN pa ON kid.pa_id = pa.id WHERE pa.name = 'cy'") == 1
    assert db.execute("DELETE FROM kid ORDER BY id LIMIT 1") == 1
    assert rows(db, "SELECT * FROM kid") == []
    db.execute("TRUNCATE TABLE kid")


@pytest.mark.parametrize("text", [
    "INSERT INTO pa (id, name) VALUES (1, 'other')", "INSERT INTO pa (name) VALUES ('ann')", "INSERT INTO pa (name) VALUES (NULL)", "INSERT INTO pa (name, amt) VALUES ('e', -1)",
    "INSERT INTO kid (id, pa_id) VALUES (9, 99)", "UPDATE pa SET name = 'same'", "UPDATE kid SET pa_id = 55", "DROP TABLE pa", "ALTER TABLE kid ADD UNIQUE (pa_id)",
])
def test_constraints_refuse_and_leave_all_as_it_was(db, text):
    before = rows(db, "SELECT * FROM pa ORDER BY id"), rows(db, "SELECT * FROM kid ORDER BY id")
    with pytest.raises(ConstraintError):
        db.execute(text)
    assert before == (rows(db, "SELECT * FROM pa ORDER BY id"), rows(db, "SELECT * FROM kid ORDER BY id"))


def test_definitions(db):
    db.execute("ALTER TABLE kid ADD COLUMN note VARCHAR(9) DEFAULT 'n' AFTER id, RENAME COLUMN twice TO double_id")
    assert [r.Field for r in db.execute("SHOW COLUMNS FROM kid").collect()] == ["id", "note", "pa_id", "double_id"]
    db.execute("ALTER TABLE kid DROP COLUMN note, MODIFY pa_id BIGINT")
    assert rows(db, "DESCRIBE kid")[1][:2] == ("pa_id", "bigint")
    db.execute("CREATE TABLE made AS SELECT name, amt * 2 AS twice FROM pa")
    db.execute("CREATE TABLE empty_like LIKE pa")
    assert rows(db, "SELECT COUNT(*) FROM made") == [(4,)] and rows(db, "SELECT COUNT(*) FROM empty_like") == [(0,)]
    db.execute("CREATE VIEW rich (who) AS SELECT name FROM pa WHERE amt > 2")
    assert rows(db, "SELECT who FROM rich") == [("dee",)]
    db.execute("UPDATE pa SET amt = 5 WHERE name = 'ann'")
    assert sorted(rows(db, "SELECT who FROM rich")) in ([("ann",), ("dee",)], [("dee",)])
    db.execute("RENAME TABLE made TO made2")
    assert {"made2", "pa", "rich"} <= {r.name for r in db.execute("SHOW TABLES").collect()}
    db.execute("CREATE INDEX by_amt ON pa (amt)")
    assert db.execute("SHOW INDEX FROM pa").count() == 3
    db.execute("DROP INDEX by_amt ON pa")
    assert "CREATE TABLE `pa`" in rows(db, "SHOW CREATE TABLE pa")[0][1]
    assert "Scan" in rows(db, "EXPLAIN SELECT * FROM pa WHERE id = 1")[0][0]
    db.execute("DROP TABLE IF EXISTS made2, no_such")
    for text in ("CREATE TABLE pa (x INT)", "DROP TABLE no_such", "SELECT FROM", "INSERT INTO pa (id) VALUES (1, 2)", "INSERT INTO kid (twice) VALUES (1)"):
        with pytest.raises(DialectError):
            db.execute(text)
    for text in ("CREATE TRIGGER t", "CALL p()", "CREATE TABLE g (p POINT)", "LOAD DATA INFILE 'x' INTO TABLE pa", "CREATE TABLE d (x DECIMAL(60))"):
        with pytest.raises(Unsupported):
            db.execute(text)


def test_transactions_and_variables(db):
    db.execute("BEGIN")
    db.execute("DELETE FROM kid")
    db.execute("SAVEPOINT s")
    db.execute("INSERT INTO kid (id) VALUES (77)")
    db.execute("ROLLBACK TO SAVEPOINT s")
    assert rows(db, "SELECT COUNT(*) FROM kid") == [(0,)]
    db.execute("ROLLBACK")
    assert rows(db, "SELECT COUNT(*) FROM kid") == [(4,)]
    db.execute("START TRANSACTION")
    db.execute("DELETE FROM kid WHERE id = 4")
    db.execute("COMMIT")
    db.execute("ROLLBACK")
    assert rows(db, "SELECT COUNT(*) FROM kid") == [(3,)]
    db.execute("SET @k = 1 + 1, @@sql_mode = 'x'")
    assert rows(db, "SELECT id FROM kid WHERE id = @k OR id = ? ORDER BY id", 3) == [(2,), (3,)]
    db.execute("DO 1 + 1")


def test_catalog(db):
    assert rows(db, "SELECT table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE' ORDER BY table_name") == [("kid",), ("pa",)]
    assert rows(db, "SELECT column_name, is_nullable, column_key FROM information_schema.columns WHERE table_name = 'pa' ORDER BY ordinal_position") == [("id", "NO", "PRI"), ("name", "NO", ""), ("amt", "YES", "")]
    assert rows(db, "SELECT constraint_name, delete_rule FROM information_schema.referential_constraints") == [("fk", "CASCADE")]
    for name in ("schemata", "statistics", "key_column_usage", "table_constraints", "check_constraints", "views", "engines", "routines"):
        db.execute(f"SELECT COUNT(*) FROM information_schema.{name}").collect()
    assert db.execute("SELECT * FROM performance_schema.session_variables").count() > 0
    with pytest.raises(Unsupported):
        db.execute("SELECT * FROM information_schema.no_such")
    assert rows(db, "SELECT LAST_INSERT_ID()") == [(1,)] or rows(db, "SELECT LAST_INSERT_ID()")[0][0] >= 1
    db.execute("UPDATE pa SET amt = 1 WHERE id < 3")
    assert rows(db, "SELECT ROW_COUNT()") == [(2,)]


def test_types_and_enum(db):
    db.execute("CREATE TABLE ty (a TINYINT UNSIGNED, b BIGINT UNSIGNED, c ENUM('x', 'y'), d DATETIME(3), e TIME, f JSON, g BLOB, h YEAR, i DOUBLE PRECISION, j BOOL)")
    db.execute("INSERT INTO ty (a, b, c, d, f) VALUES (255, 18446744073709551615, 'x', '2024-01-02 03:04:05', '{\"a\": 1}')")
    assert rows(db, "SELECT a, b, c, YEAR(d), f->>'$.a' FROM ty") == [(255, D("18446744073709551615"), "x", 2024, "1")]
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO ty (c) VALUES ('z')")
