"""Tables and row constructors as sources, and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

#: The tables of the test schema.
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: Iterable[str] = NAMES) -> None:
    """Temporary views of the tables, for SQL text."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def values(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: str | None = None) -> DataFrame:
    """``VALUES ROW(…), …``; columns are ``column_0`` and so on by default."""
    if schema is None:
        return spark.createDataFrame([tuple(r) for r in rows], [f"column_{k}" for k in range(len(rows[0]))])
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def dual(spark: SparkSession) -> DataFrame:
    """One row without columns of interest, for a SELECT without FROM."""
    return spark.range(1)


def read_delimited(spark: SparkSession, path: str, schema: str, separator: str = "\t", null: str = "\\N") -> DataFrame:
    """Text with separated fields, as a bulk load reads it."""
    return spark.read.csv(path, schema=schema, sep=separator, nullValue=null, escape="\\")


def write_delimited(df: DataFrame, path: str, separator: str = "\t", null: str = "\\N") -> None:
    df.write.mode("error").csv(path, sep=separator, nullValue=null, escape="\\")


def create_as(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    """``CREATE TABLE name SELECT …``: the columns come from the query."""
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


def create_like(spark: SparkSession, name: str, other: str) -> None:
    """``CREATE TABLE name LIKE other``: the columns without rows."""
    spark.createDataFrame([], spark.table(other).schema).write.mode("error").saveAsTable(name)


def rows(df: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time, so that a result need not fit the driver."""
    return df.toLocalIterator(prefetchPartitions=True)
