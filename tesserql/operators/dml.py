"""Writes as frames: what a table holds after a statement.

Frames do not change; these return the new contents, which a caller writes to
a new place and puts in the old one's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    """``INSERT … SELECT`` by position, cast to the target's types."""
    if len(rows.columns) != len(target.columns):
        raise ValueError("Column count doesn't match value count")
    cast = [F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(rows.columns, target.schema.fields)]
    return target.unionAll(rows.select(*cast))


def _last_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column] | None) -> DataFrame:
    """One row for each key: the last by an order, or by all columns."""
    by = list(order) if order else [F.col(f"`{c}`") for c in rows.columns]
    w = Window.partitionBy(*keys).orderBy(*[c.desc() if not order else c for c in by])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``INSERT IGNORE``: rows whose keys are new, one for each."""
    new = _last_of(rows, keys, None).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(new.select(*target.columns))


def replace(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``REPLACE``: new rows take the place of those with their keys."""
    kept = target.join(rows.select(*keys).distinct(), list(keys), "left_anti")
    return kept.select(*target.columns).unionByName(_last_of(rows, keys, None).select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], updates: Mapping[str, Column]) -> DataFrame:
    """``INSERT … ON DUPLICATE KEY UPDATE``: one full join on the keys.

    Update expressions see the stored row's columns by name and the inserted
    row's as ``new.<name>``.
    """
    incoming = _last_of(rows, keys, None)
    old = target.withColumn("_old", F.lit(True)).alias("old")
    new = incoming.withColumn("_new", F.lit(True)).alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    joined = old.join(new, on, "full")
    out = []
    for c in target.columns:
        changed = updates[c] if c in updates else F.col(f"old.{c}")
        out.append(
            F.when(F.col("_old").isNull(), F.col(f"new.{c}"))
            .when(F.col("_new").isNull(), F.col(f"old.{c}"))
            .otherwise(changed).cast(target.schema[c].dataType).alias(c)
        )
    return joined.select(*out)


def update(target: DataFrame, changes: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """``UPDATE … SET … WHERE``; later assignments see earlier ones, as the
    dialect's do from left to right."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    out = target.withColumn("_hit", hit)
    for c, value in changes.items():
        out = out.withColumn(c, F.when(F.col("_hit"), value).otherwise(F.col(c)).cast(target.schema[c].dataType))
    return out.drop("_hit")


def delete(target: DataFrame, where: Column) -> DataFrame:
    """``DELETE … WHERE``: rows for which the condition is false or unknown
    stay."""
    return target.where(~F.coalesce(where, F.lit(False)))


def update_join(target: DataFrame, other: DataFrame, keys: Sequence[str], changes: Mapping[str, Column]) -> DataFrame:
    """``UPDATE target JOIN other …``: a row changes once, by one of its
    partners; expressions name columns as ``t.<name>`` and ``o.<name>``."""
    partner = _last_of(other, keys, None).withColumn("_hit", F.lit(True)).alias("o")
    joined = target.alias("t").join(partner, [F.col(f"t.{k}") == F.col(f"o.{k}") for k in keys], "left")
    out = [
        (F.when(F.col("_hit"), changes[c]).otherwise(F.col(f"t.{c}")) if c in changes else F.col(f"t.{c}"))
        .cast(target.schema[c].dataType).alias(c)
        for c in target.columns
    ]
    return joined.select(*out)


def delete_join(target: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``DELETE target FROM target JOIN other …``."""
    return target.join(other.select(*keys), list(keys), "left_anti").select(*target.columns)


# ---------------------------------------------------------------- constraints


def check_violations(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that a CHECK refuses: those for which it is false."""
    return df.where(~condition)


def foreign_key_violations(child: DataFrame, key: str, parent: DataFrame, other: str) -> DataFrame:
    """Child rows whose key is not NULL and has no parent."""
    parents = parent.select(F.col(other).alias("_parent"))
    return child.where(F.col(key).isNotNull()).join(parents, F.col(key) == F.col("_parent"), "left_anti")


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys without a NULL that occur more than once, with their counts."""
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def delete_parents(parent: DataFrame, child: DataFrame, where: Column, key: str, other: str, action: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children after a delete, by the key's ON DELETE action:
    CASCADE, SET NULL, or RESTRICT, which keeps parents that have children."""
    gone = parent.where(F.coalesce(where, F.lit(False)))
    ids = gone.select(F.col(other).alias("_gone")).distinct()
    action = action.upper()
    if action == "CASCADE":
        return delete(parent, where), child.join(ids, F.col(key) == F.col("_gone"), "left_anti")
    if action == "SET NULL":
        marked = child.join(ids, F.col(key) == F.col("_gone"), "left")
        cleared = marked.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(*child.columns)
        return delete(parent, where), cleared
    if action in ("RESTRICT", "NO ACTION"):
        held = gone.join(child.select(F.col(key).alias("_held")), F.col(other) == F.col("_held"), "left_semi")
        return delete(parent, where).unionByName(held), child
    raise ValueError(f"ON DELETE {action}")
