import pytest

from tests.oracle import connection, difference
from tesserql.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert difference(QUERIES[name](spark, SF), connection(SF), ORACLE_SQL[name]) == ""
