import pytest

from tesserql.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("name", "column", "beyond"),
    [
        ("join_range", "p_partkey", 60),
        ("join_right", "o_orderkey", 59),
        ("bit_operators", "l_orderkey", 499),
        ("num_division", "l_orderkey", 1999),
        ("row_comparison", "l_orderkey", 299),
    ],
)
def test_rows_beyond_the_first_ids(spark, name, column, beyond):
    assert QUERIES[name](spark, SF).where(f"{column} > {beyond}").count() > 0
