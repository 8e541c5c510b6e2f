"""Control flow and session functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserql.functions.core import Arg, col, flag, truth


def if_(condition: Column, a: Arg, b: Arg) -> Column:
    return F.when(condition, col(a)).otherwise(col(b))


def if_number(n: Arg, a: Arg, b: Arg) -> Column:
    """IF over a number: nonzero is true."""
    return if_(truth(n), a, b)


def ifnull(a: Arg, b: Arg) -> Column:
    return F.coalesce(col(a), col(b))


def coalesce(*args: Arg) -> Column:
    return F.coalesce(*[col(a) for a in args])


def nullif(a: Arg, b: Arg) -> Column:
    return F.nullif(col(a), col(b))


def isnull(x: Arg) -> Column:
    return flag(col(x).isNull())


def interval(n: Arg, *bounds: Arg) -> Column:
    """How many of the ascending bounds are at most n; -1 of NULL."""
    x = col(n)
    count = F.size(F.filter(F.array(*[col(b) for b in bounds]), lambda b: b <= x))
    return F.when(x.isNull(), -1).otherwise(count)


def any_value(x: Arg) -> Column:
    return F.any_value(col(x))


def version() -> Column:
    return F.lit("8.4.11")


def database() -> Column:
    return F.current_database()


schema = database


def user() -> Column:
    return F.current_user()


current_user = session_user = system_user = user


def connection_id() -> Column:
    return F.lit(1).cast("bigint")


def charset(x: Arg, binary: bool = False) -> Column:
    return F.lit("binary" if binary else "utf8mb4")


def collation(x: Arg) -> Column:
    return F.collation(col(x))


def coercibility(kind: str) -> Column:
    """By an expression's kind: explicit, column, literal, number or null."""
    return F.lit({"explicit": 0, "column": 2, "literal": 4, "number": 5, "null": 6}[kind])
