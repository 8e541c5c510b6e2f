"""Subqueries in comparisons, and recursion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserql.plans.names import unused
from tesserql.sources.checkpoints import checkpointed

#: Rounds of a recursion whose rows stay tables of their own.
COMPACT = 8

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def facts(sub: DataFrame, column: str) -> DataFrame:
    """What a quantified comparison needs of its subquery, in one row."""
    c = F.col(column)
    return sub.agg(
        F.count("*").alias("_n"), F.count(c).alias("_known"), F.min(c).alias("_min"), F.max(c).alias("_max"),
    )


def quantified(left: DataFrame, key: str, op: str, quantifier: str, sub: DataFrame, column: str) -> DataFrame:
    """Rows for which ``key op ANY|ALL (SELECT column …)`` is true.

    Orders need the subquery's least and greatest value and its counts only:
    one row, joined to every row.  ``= ANY`` and ``<> ALL`` are memberships.
    """
    quantifier = {"SOME": "ANY"}.get(quantifier.upper(), quantifier.upper())
    x = F.col(key)
    if (op, quantifier) == ("=", "ANY"):
        other = unused("_other", left)
        return left.join(sub.select(F.col(column).alias(other)), x == F.col(other), "left_semi")
    if (op, quantifier) == ("<>", "ALL"):
        from tesserql.operators.joins import not_in

        return not_in(left, key, sub, column)
    of = {c: unused(c, left) for c in ("_min", "_max", "_n", "_known")}
    one = left.join(F.broadcast(facts(sub, column).withColumnsRenamed(of)))  # one row
    compare = _COMPARE[op]
    if quantifier == "ANY":
        if op == "<>":  # some value differs
            true = (x != F.col(of["_min"])) | (x != F.col(of["_max"]))
        else:
            true = compare(x, F.col(of["_max" if op in ("<", "<=") else "_min"]))
    else:
        if op == "=":
            every = (x == F.col(of["_min"])) & (x == F.col(of["_max"]))
        else:
            every = compare(x, F.col(of["_min" if op in ("<", "<=") else "_max"]))
        true = (F.col(of["_n"]) == 0) | (every & (F.col(of["_known"]) == F.col(of["_n"])))
    return one.where(true).select(*left.columns)


def scalar(sub: DataFrame, column: str) -> DataFrame:
    """A scalar subquery's value as one row: NULL of no row, an error of more."""
    limited = sub.select(column).limit(2)
    c = F.count("*")
    value = F.when(c > 1, F.raise_error(F.lit("Subquery returns more than 1 row"))).otherwise(F.max(column))
    return limited.agg(value.alias(column))


def recursive_distinct(
    seed: DataFrame, step: Callable[[DataFrame], DataFrame], depth: int = 1000
) -> DataFrame:
    """``WITH RECURSIVE … UNION DISTINCT``: rows of the seed and of all steps,
    each once, until a step gives nothing new.

    A round's new rows are written to the shared folder, and after ``COMPACT``
    rounds the rows so far as one table, so that the plan has no more than as
    many scans and a lost executor's work does not grow with the depth.
    """
    new = checkpointed(seed.distinct())
    found = new
    for k in range(depth):
        new = checkpointed(step(new).distinct().subtract(found))
        if new.isEmpty():
            return found
        found = found.union(new)
        if k % COMPACT == COMPACT - 1:
            found = checkpointed(found)
    raise RecursionError(f"Recursive query aborted after {depth} iterations")


def recursive_all(seed: DataFrame, step: Callable[[DataFrame], DataFrame], depth: int = 1000) -> DataFrame:
    """``WITH RECURSIVE … UNION ALL`` as a loop, for steps that SQL text cannot
    hold; see Spark's own ``WITH RECURSIVE`` for others."""
    new = checkpointed(seed)
    found = new
    for k in range(depth):
        new = checkpointed(step(new))
        if new.isEmpty():
            return found
        found = found.union(new)
        if k % COMPACT == COMPACT - 1:
            found = checkpointed(found)
    raise RecursionError(f"Recursive query aborted after {depth} iterations")
