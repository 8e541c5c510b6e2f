"""INFORMATION_SCHEMA, PERFORMANCE_SCHEMA and SHOW over the session's catalog.

These describe a catalog, not data: their rows are built on the driver from
as many entries as there are tables and columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType

#: How Spark's types are called here.
_NAMES = {
    "tinyint": "tinyint", "smallint": "smallint", "int": "int", "bigint": "bigint", "float": "float", "double": "double",
    "string": "varchar", "binary": "varbinary", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "datetime",
    "boolean": "tinyint",
}

COLUMNS = (
    "table_schema string, table_name string, column_name string, ordinal_position bigint, is_nullable string, "
    "data_type string, numeric_precision bigint, numeric_scale bigint, column_type string, column_key string"
)


def type_name(t: DataType) -> str:
    name = t.simpleString()
    return "decimal" if name.startswith("decimal") else _NAMES.get(name, "json")


def columns_of(schema: str, name: str, df: DataFrame) -> list[tuple]:
    out = []
    for k, f in enumerate(df.schema.fields, 1):
        kind = type_name(f.dataType)
        precision = getattr(f.dataType, "precision", None) if kind == "decimal" else None
        scale = getattr(f.dataType, "scale", None) if kind == "decimal" else None
        full = f"decimal({precision},{scale})" if kind == "decimal" else kind
        out.append((schema, name, f.name, k, "YES" if f.nullable else "NO", kind, precision, scale, full, f.metadata.get("key", "")))
    return out


def columns(spark: SparkSession, frames: dict[str, DataFrame] | None = None, schema: str = "def") -> DataFrame:
    """INFORMATION_SCHEMA.COLUMNS of named frames, or of the catalog's tables."""
    rows = []
    if frames is None:
        for t in spark.catalog.listTables():
            rows += columns_of((t.namespace or ["temporary"])[-1], t.name, spark.table(t.name))
    else:
        for name, df in frames.items():
            rows += columns_of(schema, name, df)
    return spark.createDataFrame(rows, COLUMNS)


def tables(spark: SparkSession) -> DataFrame:
    """INFORMATION_SCHEMA.TABLES."""
    rows = [
        ((t.namespace or ["temporary"])[-1], t.name, "VIEW" if t.tableType in ("VIEW", "TEMPORARY") else "BASE TABLE")
        for t in spark.catalog.listTables()
    ]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")


def views(spark: SparkSession) -> DataFrame:
    return tables(spark).where("table_type = 'VIEW'").select("table_schema", "table_name")


def schemata(spark: SparkSession) -> DataFrame:
    """INFORMATION_SCHEMA.SCHEMATA, also SHOW DATABASES."""
    rows = [(d.name, "utf8mb4", "utf8mb4_0900_ai_ci") for d in spark.catalog.listDatabases()]
    return spark.createDataFrame(rows, "schema_name string, default_character_set_name string, default_collation_name string")


def statistics(spark: SparkSession, keys: dict[str, dict[str, list[str]]]) -> DataFrame:
    """INFORMATION_SCHEMA.STATISTICS of declared keys: table, key, columns."""
    rows = [
        (t, int(k != "PRIMARY" and not k.startswith("uk_")), k, n, c)
        for t, own in keys.items() for k, cs in own.items() for n, c in enumerate(cs, 1)
    ]
    return spark.createDataFrame(rows, "table_name string, non_unique int, index_name string, seq_in_index int, column_name string")


def table_constraints(spark: SparkSession, keys: dict[str, dict[str, list[str]]], foreign: dict[str, dict[str, tuple]], checks: dict[str, dict[str, str]]) -> DataFrame:
    rows = [(t, k, "PRIMARY KEY" if k == "PRIMARY" else "UNIQUE") for t, own in keys.items() for k in own if k == "PRIMARY" or k.startswith("uk_")]
    rows += [(t, k, "FOREIGN KEY") for t, own in foreign.items() for k in own]
    rows += [(t, k, "CHECK") for t, own in checks.items() for k in own]
    return spark.createDataFrame(rows, "table_name string, constraint_name string, constraint_type string")


def referential_constraints(spark: SparkSession, foreign: dict[str, dict[str, tuple]]) -> DataFrame:
    """Foreign keys: constraint to (column, parent, parent column, action)."""
    rows = [(t, k, parent, action) for t, own in foreign.items() for k, (_, parent, _, action) in own.items()]
    return spark.createDataFrame(rows, "table_name string, constraint_name string, referenced_table_name string, delete_rule string")


def key_column_usage(spark: SparkSession, keys: dict[str, dict[str, list[str]]], foreign: dict[str, dict[str, tuple]]) -> DataFrame:
    rows = [(t, k, c, n, None, None) for t, own in keys.items() for k, cs in own.items() for n, c in enumerate(cs, 1) if k == "PRIMARY" or k.startswith("uk_")]
    rows += [(t, k, c, 1, parent, other) for t, own in foreign.items() for k, (c, parent, other, _) in own.items()]
    return spark.createDataFrame(
        rows,
        "table_name string, constraint_name string, column_name string, ordinal_position int, referenced_table_name string, referenced_column_name string",
    )


def check_constraints(spark: SparkSession, checks: dict[str, dict[str, str]]) -> DataFrame:
    return spark.createDataFrame([(k, e) for own in checks.values() for k, e in own.items()], "constraint_name string, check_clause string")


def engines(spark: SparkSession) -> DataFrame:
    rows = [("PARQUET", "DEFAULT", "Columnar files"), ("MEMORY", "YES", "Cached frames")]
    return spark.createDataFrame(rows, "engine string, support string, comment string")


def routines(spark: SparkSession) -> DataFrame:
    rows = [(f.name, "FUNCTION") for f in spark.catalog.listFunctions() if not f.isTemporary or f.catalog]
    return spark.createDataFrame(rows, "routine_name string, routine_type string")


def variables(spark: SparkSession, like: str = "%") -> DataFrame:
    """PERFORMANCE_SCHEMA.SESSION_VARIABLES, also SHOW VARIABLES."""
    held = spark.sql("SET").selectExpr("key AS variable_name", "value AS variable_value")
    return held.where(held.variable_name.like(like))


def describe(df: DataFrame, name: str = "t") -> DataFrame:
    """SHOW COLUMNS."""
    return columns(df.sparkSession, {name: df}).selectExpr("column_name AS Field", "column_type AS Type", "is_nullable AS Null", "column_key AS Key")


def create_table(df: DataFrame, name: str) -> str:
    """SHOW CREATE TABLE."""
    lines = [f"  `{c}` {full}{'' if null == 'YES' else ' NOT NULL'}" for _, _, c, _, null, _, _, _, full, _ in columns_of("", name, df)]
    return f"CREATE TABLE `{name}` (\n" + ",\n".join(lines) + "\n)"
