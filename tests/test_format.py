"""FORMAT of doubles: in query text, and by the query that has it."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tesserql.dialect import Dialect
from tesserql.queries import ORACLE_SQL, QUERIES
from tests.oracle import connection, difference

SF = "/root/testdata/sf0.001"

BALANCES = [-0.0, 0.0, -0.001, 0.001, -0.005, 0.005, 1.005, -1.005, 0.125, -0.125, 2.675, 999999.995, -999.995, 4516.95, -123456.7, 123456789012.34, 1e17, 5e-324, None]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("FORMAT(-0e0, 2)", "-0.00"),
        ("FORMAT(-0.001e0, 2)", "-0.00"),
        ("FORMAT(-0.001, 2)", "0.00"),
        ("FORMAT(1.005e0, 2)", "1.00"),
        ("FORMAT(1.005, 2)", "1.01"),
        ("FORMAT(-1234.5e0, 0)", "-1,235"),
        ("FORMAT(1234.5e0, -1)", "1,235"),
        ("FORMAT(0.5e0, 31)", "0." + "5".ljust(30, "0")),
        ("FORMAT('-1234.5x', 1)", "-1,234.5"),
        ("FORMAT('abc', 1)", "0.0"),
        ("FORMAT(1e30, 0)", "1" + 10 * ",000"),
        ("FORMAT(1e307, 2)", "10" + 102 * ",000" + ".00"),
        ("FORMAT(SQRT(-1), 2)", None),
    ],
)
def test_values(spark, text, value):
    assert Dialect(spark).sql(f"SELECT {text} AS x").first().x == value


def test_balances_as_sql_has_them(spark, tmp_path):
    for name in os.listdir(SF):
        if name != "customer.parquet":
            (tmp_path / name).symlink_to(f"{SF}/{name}")
    n = len(BALANCES)
    columns = [list(range(n)), [f"Customer#{k:09d}" for k in range(n)], list(range(n)), BALANCES, ["FURNITURE"] * n]
    schema = pq.read_schema(f"{SF}/customer.parquet")
    pq.write_table(pa.table(dict(zip(schema.names, columns, strict=True)), schema=schema), tmp_path / "customer.parquet")
    assert difference(QUERIES["text_encodings"](spark, str(tmp_path)), connection(str(tmp_path)), ORACLE_SQL["text_encodings"]) == ""
