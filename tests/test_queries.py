import pytest

from tests.oracle import connection, difference
from tesserql.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE_SQL:
        assert difference(df, con, ORACLE_SQL[name]) == ""
    else:
        assert df.count() > 0
