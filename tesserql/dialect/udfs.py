"""Vectorised functions that query text calls by name, where neither Spark's
functions nor compositions of them have the dialect's meaning."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, StringType

from tesserql.functions import json as j
from tesserql.functions import network


def _over(fn: Callable[..., Any], kind: DataType, arity: int):
    """A Pandas UDF of so many texts; NULL where any is NULL."""

    def run(rows) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else fn(*row) for row in rows], dtype=object)

    if arity == 1:
        def one(a: pd.Series) -> pd.Series:
            return run(zip(a))

        return F.pandas_udf(one, kind)
    if arity == 2:
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(zip(a, b))

        return F.pandas_udf(two, kind)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(zip(a, b, c))

    return F.pandas_udf(three, kind)


def extract(doc: str, paths: str) -> str | None:
    steps = [j.legs(p) for p in json.loads(paths)]
    value = j.parse(doc)
    found = [x for s in steps for x in j.select(value, s)]
    if not found:
        return None
    return j.write(found if len(steps) > 1 or j.many(steps[0]) else found[0])


def contains(doc: str, candidate: str, path: str) -> int | None:
    found = list(j.select(j.parse(doc), j.legs(path)))
    return int(j.contains(found[0], j.parse(candidate))) if found else None


def contains_path(doc: str, which: str, paths: str) -> int:
    value = j.parse(doc)
    need = any if which.lower() == "one" else all
    return int(need(any(True for _ in j.select(value, j.legs(p))) for p in json.loads(paths)))


def length(doc: str, path: str) -> int | None:
    for v in j.select(j.parse(doc), j.legs(path)):
        return len(v) if isinstance(v, dict | list) else 1
    return None


def keys(doc: str, path: str) -> str | None:
    for v in j.select(j.parse(doc), j.legs(path)):
        return j.write(sorted(v, key=j.sort_key)) if isinstance(v, dict) else None
    return None


def member(value: str, doc: str) -> int:
    inside = j.parse(doc)
    return int(any(j.same(j.parse(value), x) for x in (inside if isinstance(inside, list) else [inside])))


def register(spark: SparkSession) -> None:
    text, whole = StringType(), IntegerType()
    for name, fn, kind, arity in (
        ("tq_json_extract", extract, text, 2),
        ("tq_json_contains", contains, whole, 3),
        ("tq_json_contains_path", contains_path, whole, 3),
        ("tq_json_overlaps", lambda a, b: int(j.overlaps(j.parse(a), j.parse(b))), whole, 2),
        ("tq_json_length", length, whole, 2),
        ("tq_json_keys", keys, text, 2),
        ("tq_json_depth", lambda d: j.depth(j.parse(d)), whole, 1),
        ("tq_json_member", member, whole, 2),
        ("tq_json_normal", lambda d: j.write(j.parse(d)), text, 1),
    ):
        spark.udf.register(name, _over(fn, kind, arity))
    spark.udf.register("tq_inet6_aton", network._to_bytes)
    spark.udf.register("tq_inet6_ntoa", network._to_text)


