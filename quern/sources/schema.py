"""What is known about tables: listing, metadata, statistics, and walks along foreign keys."""

from __future__ import annotations

import enum
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import TableDoesNotExist
from quern.functions.types import split_type
from quern.sources.store import ForeignKey, Store, Table

DEFAULT_SCHEMA = "public"


@dataclass(frozen=True)
class ObjectId:
    """Names one object: equal for equal database, schema, kind, table and name."""

    database: str
    schema: str
    kind: str
    table: str
    name: str


@dataclass(frozen=True)
class ColumnMetadata:
    table: str
    name: str
    sql_type: str
    nullable: bool
    length: int | None = None
    precision: int | None = None
    scale: int | None = None


@dataclass(frozen=True)
class KeyMetadata:
    name: str
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class ForeignKeyMetadata(KeyMetadata):
    target: str = ""
    target_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableMetadata:
    database: str
    schema: str
    name: str
    comment: str | None
    columns: dict[str, ColumnMetadata]
    primary_key: KeyMetadata | None
    foreign_keys: tuple[ForeignKeyMetadata, ...]
    reverse_foreign_keys: tuple[ForeignKeyMetadata, ...]

    @property
    def identity(self) -> ObjectId:
        return ObjectId(self.database, self.schema, "table", self.name, self.name)


class Introspector:
    """Reads the declarations of a store and Spark's catalog."""

    def __init__(self, store: Store):
        self._store = store.load_all()

    def current_database(self) -> str:
        return self._store.spark.catalog.currentDatabase()

    def databases(self) -> list[str]:
        return sorted(d.name for d in self._store.spark.catalog.listDatabases())

    def schemas(self, database: str | None = None) -> list[str]:
        return sorted({_split(n)[0] for n in self._store.tables})

    def tables(self, schema: str | None = DEFAULT_SCHEMA) -> list[str]:
        """Tables of a schema, or of all, in order; views that are not tables don't count."""
        return sorted(_split(n)[1] for n in self._store.tables if schema in (None, _split(n)[0]))

    def table_exists(self, name: str, schema: str = DEFAULT_SCHEMA) -> bool:
        return self._find(name, schema) is not None

    def _find(self, name: str, schema: str = DEFAULT_SCHEMA) -> Table | None:
        return self._store.find(name if schema == DEFAULT_SCHEMA or "." in name else f"{schema}.{name}")

    def table(self, name: str, schema: str = DEFAULT_SCHEMA) -> TableMetadata:
        table = self._find(name, schema)
        if table is None:
            raise TableDoesNotExist(f"Table {schema}.{name} does not exist", sqlstate="42P01")
        columns = {}
        for c in table.definitions:
            base, brackets, _ = split_type(c.sql_type)
            sizes = [int(x) for x in brackets.strip("()").split(",") if x.strip()]
            exact = base == "decimal" or base.startswith("decimal")
            columns[c.name] = ColumnMetadata(
                table.name, c.name, c.sql_type, c.nullable,
                length=sizes[0] if sizes and not exact else None,
                precision=sizes[0] if sizes and exact else None,
                scale=sizes[1] if len(sizes) > 1 and exact else None,
            )
        primary = KeyMetadata(f"{table.name}_pkey", table.name, table.primary_key) if table.primary_key else None
        own = tuple(_foreign(table.name, k) for k in table.foreign_keys)
        back = tuple(_foreign(t.name, k) for t in self._store.tables.values() for k in t.foreign_keys if k.target == table.name)
        schema, plain = _split(table.name)
        return TableMetadata(self.current_database(), schema, plain, table.comment, columns, primary, own, back)

    # statistics
    def table_statistics(self, names: list[str] | None = None) -> DataFrame:
        """table_name, row_count, column_count, size_bytes of all or the named tables: rows are counted by Spark, one scan a table."""
        frames = []
        for name in sorted(self._store.get(n).name for n in (names or self._store.tables)):
            frame = self._store.frame(name)
            size = F.sum(reduce(lambda a, b: a + b, (_bytes(frame, c) for c in frame.columns)))
            frames.append(
                frame.agg(F.count("*").alias("row_count"), F.coalesce(size, F.lit(0)).cast("long").alias("size_bytes")).select(
                    F.lit(name).alias("table_name"), "row_count", F.lit(len(frame.columns)).cast("long").alias("column_count"), "size_bytes"
                )
            )
        return reduce(DataFrame.unionByName, frames)

    def column_statistics(self, name: str) -> DataFrame:
        """column_name, total_bytes, average_bytes, percent, nulls of a table's columns, from one scan."""
        frame = self._store.frame(self._store.get(name).name)
        aggregates = [F.count("*").alias("n")]
        for k, c in enumerate(frame.columns):
            aggregates += [F.coalesce(F.sum(_bytes(frame, c)), F.lit(0)).cast("long").alias(f"b{k}"), F.count_if(F.col(f"`{c}`").isNull()).alias(f"z{k}")]
        found = frame.agg(*aggregates)
        total = reduce(lambda a, b: a + b, (F.col(f"b{k}") for k in range(len(frame.columns))))
        items = [
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"b{k}").alias("total_bytes"),
                F.when(F.col("n") > 0, F.round(F.col(f"b{k}") / F.col("n"), 6)).alias("average_bytes"),
                F.when(total > 0, F.round(F.col(f"b{k}") * 100 / total, 6)).alias("percent"),
                F.col(f"z{k}").alias("nulls"),
            )
            for k, c in enumerate(frame.columns)
        ]
        return found.select(F.inline(F.array(*items)))


def _bytes(frame: DataFrame, column: str) -> F.Column:
    return F.coalesce(F.octet_length(F.col(f"`{column}`").cast("string")), F.lit(0)).cast("long")


def _split(name: str) -> tuple[str, str]:
    schema, dot, plain = name.partition(".")
    return (schema, plain) if dot else (DEFAULT_SCHEMA, name)


def _foreign(owner: str, key: ForeignKey) -> ForeignKeyMetadata:
    return ForeignKeyMetadata(key.name, owner, key.columns, key.target, key.target_columns)


class Direction(enum.Enum):
    NORMAL = 1
    REVERSE = 2
    BOTH = 3


class Visitor:
    """What a walk calls; all methods may be left out."""

    def schema(self, name: str) -> None: ...

    def table(self, table: TableMetadata) -> None: ...

    def column(self, table: TableMetadata, column: ColumnMetadata) -> None: ...

    def primary_key(self, table: TableMetadata, key: KeyMetadata) -> None: ...

    def foreign_key(self, table: TableMetadata, key: ForeignKeyMetadata) -> None: ...

    def reverse_foreign_key(self, table: TableMetadata, key: ForeignKeyMetadata) -> None: ...


class Browser:
    """Walks from tables along foreign keys; each table is visited once, and keys into the own table are not followed."""

    def __init__(self, introspector: Introspector, *visitors: Visitor):
        self._in, self._visitors = introspector, visitors

    def browse_schema(self, schema: str = DEFAULT_SCHEMA, direction: Direction = Direction.NORMAL) -> None:
        for v in self._visitors:
            v.schema(schema)
        seen: set[str] = set()
        for name in self._in.tables(schema):
            self._visit(name if schema == DEFAULT_SCHEMA else f"{schema}.{name}", direction, seen)

    def browse_table(self, name: str, direction: Direction = Direction.NORMAL) -> None:
        self._visit(name, direction, set())

    def _visit(self, start: str, direction: Direction, seen: set[str]) -> None:
        waiting = [start]
        while waiting:
            name = waiting.pop(0)
            if name in seen:
                continue
            seen.add(name)
            table = self._in.table(name)
            for v in self._visitors:
                v.table(table)
                for c in table.columns.values():
                    v.column(table, c)
                if table.primary_key:
                    v.primary_key(table, table.primary_key)
                for key in table.foreign_keys:
                    v.foreign_key(table, key)
                for key in table.reverse_foreign_keys:
                    v.reverse_foreign_key(table, key)
            waiting += [n for n in self._next(table, direction) if n != name]

    @staticmethod
    def _next(table: TableMetadata, direction: Direction) -> Iterator[str]:
        if direction in (Direction.NORMAL, Direction.BOTH):
            yield from (k.target for k in table.foreign_keys)
        if direction in (Direction.REVERSE, Direction.BOTH):
            yield from (k.table for k in table.reverse_foreign_keys)


class Graph(Visitor):
    """Draws what it visits as Graphviz text."""

    def __init__(self) -> None:
        self._nodes: dict[str, list[str]] = {}
        self._edges: dict[tuple[str, str, str], None] = {}

    def table(self, table: TableMetadata) -> None:
        self._nodes.setdefault(_full(table), [])

    def column(self, table: TableMetadata, column: ColumnMetadata) -> None:
        marks = "" if column.nullable else " not null"
        self._nodes[_full(table)].append(f"{column.name}: {column.sql_type}{marks}")

    def foreign_key(self, table: TableMetadata, key: ForeignKeyMetadata) -> None:
        self._edges[_full(table), key.target, ", ".join(key.columns)] = None

    def reverse_foreign_key(self, table: TableMetadata, key: ForeignKeyMetadata) -> None:
        self._edges[key.table, _full(table), ", ".join(key.columns)] = None

    def text(self) -> str:
        def text(x: str) -> str:
            return x.replace("\\", "\\\\").replace('"', '\\"').replace("{", "\\{").replace("}", "\\}").replace("|", "\\|").replace("<", "\\<").replace(">", "\\>")

        lines = ["digraph tables {", "  rankdir=LR;", "  node [shape=record];"]
        for name, columns in self._nodes.items():
            rows = "".join(text(c) + "\\l" for c in columns)
            lines.append(f'  "{text(name)}" [label="{text(name)}|{rows}"];')
        lines += [f'  "{text(a)}" -> "{text(b)}" [label="{text(label)}"];' for a, b, label in self._edges]
        return "\n".join([*lines, "}"])


def _full(table: TableMetadata) -> str:
    return table.name if table.schema == DEFAULT_SCHEMA else f"{table.schema}.{table.name}"


def human_count(n: float) -> str:
    """A count with K, M, G, T for thousands."""
    return _human(n, 1000, ["", "K", "M", "G", "T"])


def human_size(n: float) -> str:
    """Bytes in steps of 1024."""
    return _human(n, 1024, ["B", "KiB", "MiB", "GiB", "TiB"])


def _human(n: float, step: int, units: list[str]) -> str:
    k = 0
    while abs(n) >= step and k < len(units) - 1:
        n, k = n / step, k + 1
    return f"{n:.0f} {units[k]}".strip() if k == 0 else f"{n:.1f} {units[k]}"
