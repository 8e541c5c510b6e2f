"""Arguments, coercion and three-valued logic shared by all functions.

A ``str`` argument names a column; other Python values are literals.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

Arg = Column | str | int | float | bool | Decimal | None


def col(x: Arg) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def text(x: Arg) -> Column:
    return col(x).cast("string")


def number_of(x: Arg) -> Column:
    """A string in a numeric context: its longest numeric prefix, else 0."""
    prefix = F.regexp_extract(text(x), r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.when(col(x).isNull(), None).otherwise(F.coalesce(prefix.try_cast("double"), F.lit(0.0)))


def integer_of(x: Arg) -> Column:
    """CAST(text AS SIGNED): leading digits only, else 0."""
    prefix = F.regexp_extract(text(x), r"^\s*([+-]?[0-9]+)", 1)
    return F.when(col(x).isNull(), None).otherwise(F.coalesce(prefix.try_cast("bigint"), F.lit(0)))


def truth(x: Arg) -> Column:
    """Truth of a number: nonzero, NULL for NULL."""
    return col(x).cast("double") != 0


def flag(condition: Column) -> Column:
    """A predicate's value as the dialect has it: 1, 0 or NULL."""
    return condition.cast("int")


def xor(a: Column, b: Column) -> Column:
    """Exclusive or of two conditions; NULL if either is."""
    return a != b


def null_if_any(args: list[Column], value: Column) -> Column:
    missing = args[0].isNull()
    for a in args[1:]:
        missing = missing | a.isNull()
    return F.when(missing, None).otherwise(value)
