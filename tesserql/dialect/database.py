"""A database of immutable snapshots: definitions, writes and transactions.

A table is a definition and a Parquet snapshot below the shared folder, seen
through a temporary view.  A write computes the table's next contents as one
frame, writes them as a new snapshot, checks the declared constraints on it and
only then lets the view show it; a statement that fails leaves everything as it
was.  A transaction keeps the snapshots from its beginning, so that rolling back
is showing those again.  Work is what the frames cost: whole-table rewrites suit
bulk changes of analytic tables, not single-row traffic.
"""

from __future__ import annotations

import copy
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tesserql.dialect.parser import DialectError, Node, Unsupported
from tesserql.dialect.statements import parse_command
from tesserql.dialect.translate import Dialect, Scope, Translator, kind_of
from tesserql.sources import catalog
from tesserql.sources.checkpoints import checkpointed, shared_folder


class ConstraintError(ValueError):
    """A write that a constraint refuses."""


#: Column types without sizes.
TYPES = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "mediumint": "INT", "int": "INT", "integer": "INT", "bigint": "BIGINT", "bool": "TINYINT", "boolean": "TINYINT",
    "serial": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "real": "DOUBLE", "date": "DATE", "datetime": "TIMESTAMP_NTZ", "timestamp": "TIMESTAMP", "year": "SMALLINT",
    "time": "INTERVAL DAY TO SECOND", "json": "STRING", "char": "STRING", "varchar": "STRING", "text": "STRING", "tinytext": "STRING", "mediumtext": "STRING", "longtext": "STRING",
    "nchar": "STRING", "nvarchar": "STRING", "enum": "STRING", "set": "STRING", "binary": "BINARY", "varbinary": "BINARY", "blob": "BINARY", "tinyblob": "BINARY",
    "mediumblob": "BINARY", "longblob": "BINARY", "bit": "BIGINT",
}
WIDER = {"TINYINT": "SMALLINT", "SMALLINT": "INT", "INT": "BIGINT", "BIGINT": "DECIMAL(20,0)"}


def spark_type(name: str) -> str:
    word, _, rest = name.partition("(")
    size, unsigned = rest.partition(")")[0], name.endswith(" unsigned")
    word = word.removesuffix(" unsigned")
    if word in ("decimal", "numeric", "dec", "fixed"):
        precision, _, scale = (size or "10,0").partition(",")
        if int(precision) > 38:
            raise Unsupported("DECIMAL of more than 38 digits")
        return f"DECIMAL({precision},{scale or 0})"
    if word not in TYPES:
        raise Unsupported(f"column type {name}")
    return WIDER.get(TYPES[word], TYPES[word]) if unsigned or word == "serial" else TYPES[word]


@dataclass
class Table:
    name: str
    columns: list[Node]
    keys: dict[str, tuple[list[str], bool]] = field(default_factory=dict)
    checks: dict[str, Node] = field(default_factory=dict)
    foreign: dict[str, Node] = field(default_factory=dict)
    path: str = ""
    next_id: int = 1

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Node:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise DialectError(f"Unknown column '{name}'")

    def schema(self) -> str:
        return ", ".join(f"`{c.name}` {spark_type(c.type)}" for c in self.columns)


class Database(Dialect):
    """Runs all statements; ``execute`` returns a frame, or a count of rows."""

    def __init__(self, spark: SparkSession, folder: str | None = None, ignore_case: bool = False) -> None:
        super().__init__(spark, ignore_case)
        self.folder = (folder or f"{shared_folder(spark)}/database-{uuid.uuid4().hex}").rstrip("/")
        self.tables: dict[str, Table] = {}
        self.views: dict[str, str] = {}
        self.began: dict[str, Table] | None = None
        self.savepoints: list[tuple[str, dict[str, Table]]] = []
        self.last_id = 0

    # ------------------------------------------------------------ running

    def execute(self, text: str, *parameters: Any) -> DataFrame | int:
        node = parse_command(text)
        before, known = dict(self.tables), copy.deepcopy(self.tables)
        try:
            out = getattr(self, "do_" + node.kind)(node, parameters)
            self.variables["row_count"] = out if isinstance(out, int) else -1
            return out
        except Exception:
            self.tables = {k: known[k] for k in before}
            self.show_all()
            raise

    def translator(self, parameters: tuple) -> Translator:
        return Translator(self.spark, parameters, self.variables, self.ignore_case, self.system)

    def system(self, schema: str, name: str) -> str | None:
        """A view of a catalog table, made when a query names it."""
        made = self.system_table(schema, name)
        if made is None:
            return None
        view = f"_{schema}_{name}"
        made.createOrReplaceTempView(view)
        return view

    def system_table(self, schema: str, name: str) -> DataFrame | None:
        spark, tables = self.spark, self.tables.values()
        if schema == "performance_schema":
            return catalog.variables(spark) if name in ("session_variables", "global_variables", "session_status", "global_status") else None
        keys = {t.name: {f"uk_{k}" if u and k != "PRIMARY" and not k.startswith("uk_") else k: cs for k, (cs, u) in t.keys.items()} for t in tables}
        foreign = {t.name: {k: (f.columns[0], f.parent, f.others[0], f.on_delete.upper()) for k, f in t.foreign.items()} for t in tables}
        checks = {t.name: {k: repr(c) for k, c in t.checks.items()} for t in tables}
        if name == "tables":
            rows = [(schema, t.name, "BASE TABLE") for t in tables] + [(schema, v, "VIEW") for v in self.views]
            return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")
        if name == "columns":
            rows = []
            for t in tables:
                primary = t.keys.get("PRIMARY", ([], True))[0]
                for row, c in zip(catalog.columns_of("def", t.name, self.frame(t)), t.columns):
                    rows.append((*row[:4], "YES" if c.null and c.name not in primary else "NO", *row[5:8], c.type, "PRI" if c.name in primary else ""))
            return spark.createDataFrame(rows, catalog.COLUMNS)
        if name == "views":
            return spark.createDataFrame(list(self.views.items()), "table_name string, view_definition string")
        if name == "table_constraints":
            return catalog.table_constraints(spark, keys, foreign, checks)
        made = {
            "schemata": lambda: catalog.schemata(spark), "engines": lambda: catalog.engines(spark), "routines": lambda: spark.createDataFrame([], "routine_name string, routine_type string"),
            "statistics": lambda: catalog.statistics(spark, keys), "key_column_usage": lambda: catalog.key_column_usage(spark, keys, foreign),
            "referential_constraints": lambda: catalog.referential_constraints(spark, foreign), "check_constraints": lambda: catalog.check_constraints(spark, checks),
        }.get(name)
        return made() if made else None

    def do_query(self, node: Node, parameters: tuple) -> DataFrame:
        return self.spark.sql(self.translator(parameters).query(node.query))

    def table(self, name: str) -> Table:
        found = self.tables.get(name.lower())
        if found is None:
            raise DialectError(f"Table '{name}' doesn't exist")
        return found

    def frame(self, t: Table) -> DataFrame:
        return self.spark.read.schema(t.schema()).parquet(t.path)

    def show_all(self) -> None:
        for t in self.tables.values():
            self.frame(t).createOrReplaceTempView(t.name)

    def store(self, t: Table, df: DataFrame) -> Table:
        """The table with new contents, after its constraints held."""
        kept = [f"CAST(`{c.name}` AS {spark_type(c.type)}) AS `{c.name}`" for c in t.columns]
        out = df.selectExpr(*kept)
        generated = [c for c in t.columns if c.generated is not None]
        if generated:
            out.createOrReplaceTempView("_rows_to_store")
            tr, scope = self.translator(()), Scope()
            scope.tables["_rows_to_store"] = {f.name.lower(): kind_of(f.dataType) for f in out.schema.fields}
            made = {c.name: tr.value(c.generated, scope)[0] for c in generated}
            parts = [f"CAST({made.get(c.name, f'`{c.name}`')} AS {spark_type(c.type)}) AS `{c.name}`" for c in t.columns]
            out = self.spark.sql(f"SELECT {', '.join(parts)} FROM _rows_to_store")
        new = copy.deepcopy(t)
        new.path = f"{self.folder}/{t.name}-{uuid.uuid4().hex}"
        out.write.parquet(new.path)
        self.check(new)
        self.tables[t.name.lower()] = new
        self.frame(new).createOrReplaceTempView(new.name)
        return new

    def check(self, t: Table) -> None:
        """Declared constraints on a snapshot; the first that fails is named."""
        df = self.frame(t)
        primary = t.keys.get("PRIMARY", ([], True))[0]
        for c in t.columns:
            if (not c.null or c.name in primary) and not df.where(df[c.name].isNull()).isEmpty():
                raise ConstraintError(f"Column '{c.name}' cannot be null")
            if c.members and c.type.startswith("enum"):
                if not df.where(df[c.name].isNotNull() & ~df[c.name].isin(*c.members)).isEmpty():
                    raise ConstraintError(f"Data truncated for column '{c.name}'")
        for name, (columns, unique) in t.keys.items():
            if unique:
                known = df
                for c in columns:
                    known = known.where(known[c].isNotNull())
                if not known.groupBy(*columns).count().where("count > 1").isEmpty():
                    raise ConstraintError(f"Duplicate entry for key '{t.name}.{name}'")
        if t.checks:
            tr, scope = self.translator(()), Scope()
            scope.tables[t.name.lower()] = {f.name.lower(): kind_of(f.dataType) for f in df.schema.fields}
            for name, condition in t.checks.items():
                if not df.where(f"NOT ({tr.condition(condition, scope)})").isEmpty():
                    raise ConstraintError(f"Check constraint '{name}' is violated.")
        for name, f in t.foreign.items():
            parents = df if f.parent.lower() == t.name.lower() else self.frame(self.table(f.parent))
            held = parents.selectExpr(*[f"`{o}` AS _p{k}" for k, o in enumerate(f.others)])
            known = df.selectExpr(*[f"`{c}` AS _c{k}" for k, c in enumerate(f.columns)]).dropna()
            on = [known[f"_c{k}"] == held[f"_p{k}"] for k in range(len(f.columns))]
            if not known.join(held, on, "left_anti").isEmpty():
                raise ConstraintError(f"a foreign key constraint fails ({name})")

    # ------------------------------------------------------------ definitions

    def do_create_table(self, node: Node, parameters: tuple) -> int:
        if node.name.lower() in self.tables:
            if node.exists:
                return 0
            raise DialectError(f"Table '{node.name}' already exists")
        if node.like:
            t = copy.deepcopy(self.table(node.like))
            t.name, t.foreign, t.next_id = node.name, {}, 1
            self.store(t, self.spark.createDataFrame([], t.schema()))
            return 0
        t = Table(node.name, node.columns, node.keys, node.checks, node.foreign)
        if node.query is None:
            self.store(t, self.spark.createDataFrame([], t.schema()))
            return 0
        rows = self.spark.sql(self.translator(parameters).query(node.query))
        declared = {c.name.lower() for c in t.columns}
        extra = []
        for f in rows.schema.fields:
            if f.name.lower() not in declared:
                extra.append(Node("column_def", name=f.name, type=catalog_type(f.dataType), null=True, default=None, auto=False, generated=None, members=[]))
        t.columns = t.columns + extra
        have = {c.lower() for c in rows.columns}
        filled = rows.selectExpr("*", *[f"{self.default_of(c)} AS `{c.name}`" for c in t.columns if c.name.lower() not in have])
        new = self.store(t, filled)
        return self.frame(new).count()

    def default_of(self, c: Node) -> str:
        return "NULL" if c.default is None else self.translator(()).value(c.default, Scope())[0]

    def do_create_view(self, node: Node, parameters: tuple) -> int:
        if node.name.lower() in self.views and not node.replace:
            raise DialectError(f"Table '{node.name}' already exists")
        text = self.translator(parameters).query(node.query)
        listed = f"({', '.join(f'`{c}`' for c in node.columns)})" if node.columns else ""
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{node.name}`{listed} AS {text}")
        self.views[node.name.lower()] = text
        return 0

    def do_create_database(self, node: Node, parameters: tuple) -> int:
        self.spark.sql(f"CREATE DATABASE {'IF NOT EXISTS ' if node.exists else ''}`{node.name}`")
        return 1

    def do_drop(self, node: Node, parameters: tuple) -> int:
        for name in node.names:
            held = self.tables if node.what == "table" else self.views
            if node.what in ("database", "schema"):
                self.spark.sql(f"DROP DATABASE {'IF EXISTS ' if node.exists else ''}`{name}`")
            elif name.lower() in held:
                for other in self.tables.values():
                    if node.what == "table" and other.name.lower() != name.lower() and any(f.parent.lower() == name.lower() for f in other.foreign.values()):
                        raise ConstraintError(f"Cannot drop table '{name}' referenced by a foreign key constraint")
                del held[name.lower()]
                self.spark.catalog.dropTempView(name)
            elif not node.exists:
                raise DialectError(f"Unknown table '{name}'")
        return 0

    def do_truncate(self, node: Node, parameters: tuple) -> int:
        t = copy.deepcopy(self.table(node.table))
        t.next_id = 1
        self.store(t, self.spark.createDataFrame([], t.schema()))
        return 0

    def do_rename(self, node: Node, parameters: tuple) -> int:
        for a, b in node.pairs:
            t = copy.deepcopy(self.table(a))
            if b.lower() in self.tables:
                raise DialectError(f"Table '{b}' already exists")
            del self.tables[a.lower()]
            self.spark.catalog.dropTempView(a)
            t.name = b
            self.tables[b.lower()] = t
            self.frame(t).createOrReplaceTempView(b)
        return 0

    def do_add_key(self, node: Node, parameters: tuple) -> int:
        t = copy.deepcopy(self.table(node.table))
        for c in node.columns:
            t.column(c)
        t.keys[node.name] = (node.columns, node.unique)
        self.check(t)
        self.tables[t.name.lower()] = t
        return 0

    def do_drop_key(self, node: Node, parameters: tuple) -> int:
        t = copy.deepcopy(self.table(node.table))
        if t.keys.pop(node.name, None) is None:
            raise DialectError(f"Can't DROP '{node.name}'; check that column/key exists")
        self.tables[t.name.lower()] = t
        return 0

    def do_alter(self, node: Node, parameters: tuple) -> int:
        t = copy.deepcopy(self.table(node.table))
        df = self.frame(t)
        for change in node.changes:
            if change.kind == "add_column":
                if change.column.name.lower() in [c.lower() for c in t.names()]:
                    raise DialectError(f"Duplicate column name '{change.column.name}'")
                at = len(t.columns) if change.after is None else 0 if change.after == "" else [c.lower() for c in t.names()].index(change.after.lower()) + 1
                t.columns.insert(at, change.column)
                df = df.selectExpr("*", f"CAST({self.default_of(change.column)} AS {spark_type(change.column.type)}) AS `{change.column.name}`")
                t.keys |= change.element.keys
                t.checks |= change.element.checks
            elif change.kind == "drop_column":
                t.column(change.name)
                t.columns = [c for c in t.columns if c.name.lower() != change.name.lower()]
                t.keys = {k: v for k, v in t.keys.items() if change.name.lower() not in [c.lower() for c in v[0]]}
                df = df.drop(change.name)
            elif change.kind in ("rename_column", "modify_column"):
                old = t.column(change.name)
                new = change.to if change.kind == "rename_column" else change.column.name
                if change.kind == "modify_column":
                    t.columns[t.columns.index(old)] = change.column
                else:
                    old.name = new
                t.keys = {k: ([new if c.lower() == change.name.lower() else c for c in cs], u) for k, (cs, u) in t.keys.items()}
                df = df.withColumnRenamed(change.name, new)
            elif change.kind == "add_constraint":
                t.keys |= change.element.keys
                t.checks |= change.element.checks
                t.foreign |= change.element.foreign
            elif change.kind == "drop_constraint":
                if all(held.pop(change.name, None) is None for held in (t.keys, t.checks, t.foreign)):
                    raise DialectError(f"Can't DROP '{change.name}'; check that column/key exists")
            elif change.kind == "set_default":
                t.column(change.name).default = change.default
            elif change.kind == "rename_table":
                self.store(t, df)
                return self.do_rename(Node("rename", pairs=[(t.name, change.to)]), parameters)
        self.store(t, df)
        return 0

    # ------------------------------------------------------------ writes

    def do_insert(self, node: Node, parameters: tuple) -> int:
        t = copy.deepcopy(self.table(node.table))
        columns = node.columns or [c.name for c in t.columns if c.generated is None]
        for c in columns:
            if t.column(c).generated is not None:
                raise DialectError(f"The value specified for generated column '{c}' is not allowed.")
        tr = self.translator(parameters)
        if node.rows is not None:
            for row in node.rows:
                if row and len(row) != len(columns):
                    raise DialectError("Column count doesn't match value count")
            lines = []
            for k, row in enumerate(node.rows):
                values = row or [Node("default")] * len(columns)
                cells = [self.default_of(t.column(c)) if v.kind == "default" else tr.value(v, Scope())[0] for c, v in zip(columns, values)]
                lines.append(f"SELECT {k} AS _at" + "".join(f", CAST({x} AS {spark_type(t.column(c).type)}) AS `{c}`" for c, x in zip(columns, cells)))
            new = self.spark.sql(" UNION ALL ".join(lines))
        else:
            found = self.spark.sql(tr.query(node.query))
            if len(found.columns) != len(columns):
                raise DialectError("Column count doesn't match value count")
            new = found.toDF(*columns).selectExpr("CAST(0 AS INT) AS _at", *[f"CAST(`{c}` AS {spark_type(t.column(c).type)}) AS `{c}`" for c in columns])
        given = {c.lower() for c in columns}
        new = new.selectExpr("*", *[f"CAST({self.default_of(c)} AS {spark_type(c.type)}) AS `{c.name}`" for c in t.columns if c.name.lower() not in given])
        auto = next((c for c in t.columns if c.auto), None)
        if auto is not None:
            new = self.numbered(t, auto, new, auto.name.lower() in given)
        names = [f"`{c}`" for c in t.names()]
        unique = [cs for cs, u in t.keys.values() if u]
        old = self.frame(t)
        n = new.count()
        if node.updates and unique:
            contents, n = self.upserted(t, old, new, unique, node, tr)
        elif node.kind_ == "replace" and unique:
            new = self.first_of(new, unique, last=True).select(*names)
            kept = old
            for cs in unique:
                kept = kept.join(new.select(*cs), cs, "left_anti")
            contents = kept.select(*names).unionByName(new)
        elif node.ignore and unique:
            new = self.first_of(new, unique, last=False)
            for cs in unique:
                new = new.join(old.select(*cs), cs, "left_anti")
            contents = old.unionByName(new.select(*names))
            n = new.count()
        else:
            contents = old.unionByName(new.select(*names))
        self.store(t, contents)
        return n

    def first_of(self, rows: DataFrame, unique: list[list[str]], last: bool) -> DataFrame:
        """One row for each key, in the order in which rows were given."""
        for cs in unique:
            rows.createOrReplaceTempView("_rows_to_thin")
            order = "_at DESC" if last else "_at"
            keys = ", ".join(f"`{c}`" for c in cs)
            known = " AND ".join(f"`{c}` IS NOT NULL" for c in cs)
            rows = self.spark.sql(
                f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS _n FROM _rows_to_thin) WHERE _n = 1 OR NOT ({known})"
            ).drop("_n")
        return rows

    def numbered(self, t: Table, auto: Node, rows: DataFrame, given: bool) -> DataFrame:
        """Numbers for rows without one.  Where rows bring some (``given``), the
        counter goes through them in order and follows the largest; else rows
        are numbered where they are, from bases for their partitions."""
        first, name, kind = t.next_id, f"`{auto.name}`", spark_type(auto.type)
        if given:
            rows.createOrReplaceTempView("_rows_to_number")
            counted = f"SELECT *, sum(CAST(coalesce({name}, 0) = 0 AS INT)) OVER (ORDER BY _at) AS _n FROM _rows_to_number"
            reached = f"SELECT *, greatest({first - 1}, coalesce(max(nullif({name}, 0) - _n) OVER (ORDER BY _at), 0)) AS _base FROM ({counted})"
            out = self.spark.sql(f"SELECT * EXCEPT ({name}, _n, _base), CAST(coalesce(nullif({name}, 0), _base + _n) AS {kind}) AS {name} FROM ({reached})")
            new = not rows.where(f"coalesce({name}, 0) = 0").isEmpty()
        else:
            placed = checkpointed(rows.selectExpr("*", "spark_partition_id() AS _part", "monotonically_increasing_id() AS _place"))
            counts = sorted(tuple(r) for r in placed.groupBy("_part").count().collect())  # one row for each partition
            bases = [(part, first + sum(n for _, n in counts[:k])) for k, (part, _) in enumerate(counts)]
            self.spark.createDataFrame(bases, "_part int, _base bigint").createOrReplaceTempView("_bases")
            placed.createOrReplaceTempView("_rows_to_number")
            out = self.spark.sql(
                f"SELECT r.* EXCEPT ({name}, _place), CAST(_base + row_number() OVER (PARTITION BY r._part ORDER BY _place) - 1 AS {kind}) AS {name} "
                "FROM _rows_to_number AS r JOIN _bases AS b ON r._part = b._part"
            ).drop("_part")
            new = bool(counts)
        top = out.selectExpr(f"max({name}) AS m").first().m
        if top is not None:
            if new:
                self.last_id = self.variables["last_insert_id"] = first
            t.next_id = max(first, int(top) + 1)
        return out

    def upserted(self, t: Table, old: DataFrame, new: DataFrame, unique: list[list[str]], node: Node, tr: Translator) -> tuple[DataFrame, int]:
        if len(unique) > 1:
            raise Unsupported("ON DUPLICATE KEY UPDATE with several unique keys")
        keys = unique[0]
        new = self.first_of(new, unique, last=True)
        old.createOrReplaceTempView("_old_rows")
        new.createOrReplaceTempView("_new_rows")
        scope = Scope()
        kinds = {f.name.lower(): kind_of(f.dataType) for f in old.schema.fields}
        scope.tables[t.name.lower()] = kinds
        scope.tables[(node.alias or "new").lower()] = kinds
        alias = node.alias or "new"
        updates = {target[-1].lower(): tr.value(values_to_new(v, alias), scope)[0] for target, v in node.updates}
        on = " AND ".join(f"`{t.name}`.`{k}` = `{alias}`.`{k}`" for k in keys)
        hit, fresh = f"`{t.name}`._there", f"`{alias}`._there"
        cells = [
            f"CASE WHEN {hit} IS NULL THEN `{alias}`.`{c}` WHEN {fresh} IS NULL THEN `{t.name}`.`{c}` ELSE {updates.get(c.lower(), f'`{t.name}`.`{c}`')} END AS `{c}`"
            for c in t.names()
        ]
        source = f"(SELECT *, 1 AS _there FROM _old_rows) AS `{t.name}` FULL JOIN (SELECT *, 1 AS _there FROM _new_rows) AS `{alias}` ON {on}"
        both = self.spark.sql(f"SELECT count(*) AS n FROM _old_rows AS `{t.name}` JOIN _new_rows AS `{alias}` ON {on}").first().n
        return self.spark.sql(f"SELECT {', '.join(cells)} FROM {source}"), new.count() + both

    def chosen(self, node: Node, t: Table, tr: Translator, scope: Scope) -> str:
        """The rows of one table with ``_hit``: whether a write means them."""
        hit = f"coalesce({tr.condition(node.where, scope)}, false)" if node.where is not None else "true"
        name = node.source.alias or t.name
        text = f"SELECT *, {hit} AS _hit FROM `{t.name}` AS `{name}`"
        if node.limit:
            order = ", ".join(tr.order_key(v, down, scope) for v, down in node.order) or "1"
            n = tr.value(node.limit[1], scope)[0]
            text = f"SELECT * EXCEPT (_n), _hit AND _n <= {n} AS _hit FROM (SELECT *, row_number() OVER (PARTITION BY _hit ORDER BY {order}) AS _n FROM ({text}) AS `{name}`) AS `{name}`"
            text = text.replace("* EXCEPT (_n)", "* EXCEPT (_n, _hit)", 1)
        return text

    def do_update(self, node: Node, parameters: tuple) -> int:
        tr = self.translator(parameters)
        if node.source.kind != "table":
            return self.update_joined(node, tr)
        t = self.table(node.source.name[-1])
        scope = Scope()
        tr.source(node.source, scope)
        text = self.chosen(node, t, tr, scope)
        name = node.source.alias or t.name
        for target, value in node.updates:
            c = t.column(target[-1])
            new = self.default_of(c) if value.kind == "default" else tr.value(value, scope)[0]
            cells = [f"CASE WHEN _hit THEN {new} ELSE `{name}`.`{x}` END AS `{x}`" if x.lower() == c.name.lower() else f"`{name}`.`{x}`" for x in t.names()]
            text = f"SELECT {', '.join(cells)}, _hit FROM ({text}) AS `{name}`"
        df = self.spark.sql(text)
        n = df.where("_hit").count()
        before = self.frame(t)
        new = self.store(t, df.drop("_hit"))
        self.parents_changed(t, before, self.frame(new), "on_update")
        return n

    def primary(self, t: Table) -> list[str]:
        if "PRIMARY" not in t.keys:
            raise Unsupported("a write of joined tables without a primary key")
        return t.keys["PRIMARY"][0]

    def update_joined(self, node: Node, tr: Translator) -> int:
        """One table of a join changes, by any of a row's partners."""
        if node.order or node.limit:
            raise DialectError("Incorrect usage of UPDATE and ORDER BY or LIMIT")
        scope = Scope()
        source = tr.source(node.source, scope)
        aliases = {target[0].lower() for target, _ in node.updates if len(target) > 1}
        if len(aliases) != 1 or any(len(target) < 2 for target, _ in node.updates):
            raise Unsupported("UPDATE of joined tables whose columns do not name one table")
        alias = aliases.pop()
        t = self.table(table_of(node.source, alias))
        keys = self.primary(t)
        where = f" WHERE {tr.condition(node.where, scope)}" if node.where is not None else ""
        cells = [f"`{alias}`.`{k}` AS `_k{i}`" for i, k in enumerate(keys)]
        cells += [f"{tr.value(v, scope)[0]} AS `_v{i}`" for i, (_, v) in enumerate(node.updates)]
        self.spark.sql(f"SELECT {', '.join(cells)} FROM {source}{where}").dropDuplicates([f"_k{i}" for i in range(len(keys))]).createOrReplaceTempView("_changes")
        place = {target[-1].lower(): f"_v{i}" for i, (target, _) in enumerate(node.updates)}
        out = [f"CASE WHEN c._k0 IS NULL THEN t.`{x}` ELSE c.`{place[x.lower()]}` END AS `{x}`" if x.lower() in place else f"t.`{x}`" for x in t.names()]
        on = " AND ".join(f"t.`{k}` = c.`_k{i}`" for i, k in enumerate(keys))
        df = self.spark.sql(f"SELECT {', '.join(out)} FROM `{t.name}` AS t LEFT JOIN _changes AS c ON {on}")
        n = self.spark.table("_changes").count()
        before = self.frame(t)
        self.parents_changed(t, before, self.frame(self.store(t, df)), "on_update")
        return n

    def do_delete(self, node: Node, parameters: tuple) -> int:
        tr, total = self.translator(parameters), 0
        scope = Scope()
        if node.source.kind == "table" and len(node.targets) == 1:
            t = self.table(node.source.name[-1])
            tr.source(node.source, scope)
            df = self.spark.sql(self.chosen(node, t, tr, scope))
            total = df.where("_hit").count()
            kept = df.where("NOT _hit").drop("_hit")
            return self.deleted(t, kept, total)
        source = tr.source(node.source, scope)
        where = f" WHERE {tr.condition(node.where, scope)}" if node.where is not None else ""
        plans = []
        for alias in node.targets:
            t = self.table(table_of(node.source, alias))
            keys = self.primary(t)
            cells = ", ".join(f"`{alias}`.`{k}` AS `{k}`" for k in keys)
            gone = self.spark.sql(f"SELECT DISTINCT {cells} FROM {source}{where}")
            path = f"{self.folder}/gone-{uuid.uuid4().hex}"
            gone.write.parquet(path)
            plans.append((t, keys, self.spark.read.schema(gone.schema).parquet(path)))
        for t, keys, gone in plans:
            now = self.frame(self.table(t.name))
            total += self.deleted(self.table(t.name), now.join(gone, keys, "left_anti").select(*now.columns), now.join(gone, keys, "left_semi").count())
        return total

    def deleted(self, t: Table, kept: DataFrame, n: int) -> int:
        before = self.frame(t)
        new = self.store(t, kept)
        self.parents_changed(t, before, self.frame(new), "on_delete")
        return n

    def parents_changed(self, t: Table, before: DataFrame, after: DataFrame, event: str) -> None:
        """Carry a parent's lost keys to its children by their actions."""
        for child in list(self.tables.values()):
            for name, f in child.foreign.items():
                if f.parent.lower() != t.name.lower():
                    continue
                lost = before.select(*f.others).dropna().subtract(after.select(*f.others)).toDF(*f.columns)
                rows = self.frame(self.tables[child.name.lower()])
                if rows.join(lost, f.columns, "left_semi").isEmpty():
                    continue
                action = getattr(f, event)
                if action in ("restrict", "no action"):
                    raise ConstraintError(f"Cannot delete or update a parent row: a foreign key constraint fails ({name})")
                if action == "set null":
                    kept = rows.join(lost, f.columns, "left_anti").select(*rows.columns)
                    cleared = rows.join(lost, f.columns, "left_semi").selectExpr(*[f"NULL AS `{c}`" if c in f.columns else f"`{c}`" for c in rows.columns])
                    self.store(child, kept.unionByName(cleared))
                elif event == "on_delete":
                    self.deleted(child, rows.join(lost, f.columns, "left_anti").select(*rows.columns), 0)
                else:
                    raise Unsupported("ON UPDATE CASCADE of changed keys")

    # ------------------------------------------------------------ session

    def do_set(self, node: Node, parameters: tuple) -> int:
        for name, value in node.pairs:
            text = self.translator(parameters).value(value, Scope())[0] if value.kind != "column" else f"'{value.parts[-1]}'"
            if name.startswith("@@"):
                continue  # settings of a server have no meaning for frames
            self.set(name, self.spark.sql(f"SELECT {text} AS x").first().x)
        return 0

    def do_use(self, node: Node, parameters: tuple) -> int:
        self.spark.sql(f"USE `{node.name}`")
        return 0

    def do_do(self, node: Node, parameters: tuple) -> int:
        self.spark.sql("SELECT " + ", ".join(self.translator(parameters).value(v, Scope())[0] for v in node.values)).collect()
        return 0

    def do_begin(self, node: Node, parameters: tuple) -> int:
        self.began, self.savepoints = dict(self.tables), []
        return 0

    def do_commit(self, node: Node, parameters: tuple) -> int:
        self.began, self.savepoints = None, []
        return 0

    def restore(self, held: dict[str, Table]) -> None:
        for name in set(self.tables) - set(held):
            self.spark.catalog.dropTempView(self.tables[name].name)
        self.tables = dict(held)
        self.show_all()

    def do_rollback(self, node: Node, parameters: tuple) -> int:
        if node.savepoint:
            for k in range(len(self.savepoints) - 1, -1, -1):
                if self.savepoints[k][0].lower() == node.savepoint.lower():
                    self.restore(self.savepoints[k][1])
                    del self.savepoints[k + 1 :]
                    return 0
            raise DialectError(f"SAVEPOINT {node.savepoint} does not exist")
        if self.began is not None:
            self.restore(self.began)
        self.began, self.savepoints = None, []
        return 0

    def do_savepoint(self, node: Node, parameters: tuple) -> int:
        self.savepoints = [s for s in self.savepoints if s[0].lower() != node.name.lower()] + [(node.name, dict(self.tables))]
        return 0

    def do_release(self, node: Node, parameters: tuple) -> int:
        self.savepoints = [s for s in self.savepoints if s[0].lower() != node.name.lower()]
        return 0

    def do_show(self, node: Node, parameters: tuple) -> DataFrame:
        spark = self.spark
        if node.what == "create":
            if node.name.lower() in self.views:
                return spark.createDataFrame([(node.name, self.views[node.name.lower()])], "View string, `Create View` string")
            return spark.createDataFrame([(node.name, catalog.create_table(self.frame(self.table(node.name)), node.name))], "Table string, `Create Table` string")
        if node.what == "columns":
            t = self.table(node.name)
            key_of = {c: "PRI" if k == "PRIMARY" else "UNI" if u else "MUL" for k, (cs, u) in reversed(t.keys.items()) for c in cs}
            rows = [(c.name, c.type, "YES" if c.null and key_of.get(c.name) != "PRI" else "NO", key_of.get(c.name, ""), self.default_of(c).strip("'") if c.default is not None else None, "auto_increment" if c.auto else "") for c in t.columns]
            return spark.createDataFrame(rows, "Field string, Type string, `Null` string, Key string, `Default` string, Extra string")
        if node.what == "index":
            return catalog.statistics(spark, {node.name: {k: cs for k, (cs, _) in self.table(node.name).keys.items()}})
        if node.what in ("tables", "table"):
            names = [(t.name,) for t in self.tables.values()] + [(v,) for v in self.views]
            listed = spark.createDataFrame(sorted(names), "name string")
            return listed.where(listed.name.like(node.like))
        if node.what in ("databases", "schemas"):
            return catalog.schemata(spark).select("schema_name")
        if node.what == "engines":
            return catalog.engines(spark)
        if node.what in ("warnings", "errors"):
            return spark.createDataFrame([], "Level string, Code int, Message string")
        return catalog.variables(spark, node.like)

    def do_explain(self, node: Node, parameters: tuple) -> DataFrame:
        df = self.spark.sql(self.translator(parameters).query(node.query))
        return self.spark.createDataFrame([(df._jdf.queryExecution().executedPlan().toString(),)], "EXPLAIN string")

    def do_analyze(self, node: Node, parameters: tuple) -> DataFrame:
        self.table(node.table)
        return self.spark.createDataFrame([(node.table, "analyze", "status", "OK")], "Table string, Op string, Msg_type string, Msg_text string")


def catalog_type(t: Any) -> str:
    """A definition's type for a frame's."""
    name = t.simpleString()
    if name.startswith("decimal"):
        return name
    return {"tinyint": "tinyint", "smallint": "smallint", "int": "int", "bigint": "bigint", "float": "float", "double": "double", "date": "date", "timestamp": "timestamp",
            "timestamp_ntz": "datetime", "binary": "blob", "boolean": "tinyint", "void": "varchar"}.get(name, "time" if name.startswith("interval") else "text")


def table_of(source: Node, alias: str) -> str:
    """The table that an alias names in a join."""
    if source.kind == "join":
        for side in (source.left, source.right):
            try:
                return table_of(side, alias)
            except DialectError:
                continue
    elif source.kind == "table" and (source.alias or source.name[-1]).lower() == alias.lower():
        return source.name[-1]
    raise DialectError(f"Unknown table '{alias}'")


def values_to_new(node: Any, alias: str) -> Any:
    """``VALUES(c)`` as a column of the inserted row."""
    if isinstance(node, Node):
        if node.kind == "call" and node.name == "values":
            return Node("column", parts=[alias, node.args[0].parts[-1]])
        return Node(**{k: values_to_new(v, alias) for k, v in node.__dict__.items()})
    if isinstance(node, list):
        return [values_to_new(v, alias) for v in node]
    if isinstance(node, tuple):
        return tuple(values_to_new(v, alias) for v in node)
    return node
