"""Named tables: read-only frames and copy-on-write Parquet versions, with constraints and defaults.

A version is a list of Parquet files, those that the table was read from included. Inserting adds files and rewrites nothing; updating
and deleting write the files anew that hold touched rows, and keep all others. A row is known by its file and its place in it.
Constraints are checked for the rows that came or went, against the keys of the others, so a small change does not shuffle a
large table. Old versions stay until the store is closed, so a snapshot is a copy of the table of versions.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import ForeignKeyViolation, NotNullViolation, QueryError, TableDoesNotExist, UniqueViolation
from quern.functions.types import canonical, spark_type

#: Hidden columns: the file of a row, and its place there.
FILE, PLACE = "__file", "__place"
#: Rows of keys up to which they are broadcast to the table that they are held against.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Column:
    name: str
    sql_type: str
    nullable: bool = True
    serial: bool = False
    default: str | None = None

    @property
    def spark(self) -> str:
        return spark_type(self.sql_type)


@dataclass(frozen=True)
class Unique:
    name: str
    columns: tuple[str, ...]
    deferrable: bool = False


@dataclass(frozen=True)
class ForeignKey:
    name: str
    columns: tuple[str, ...]
    target: str
    target_columns: tuple[str, ...]
    deferrable: bool = False


@dataclass(frozen=True)
class Table:
    """What is declared about a table."""

    name: str
    definitions: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    uniques: tuple[Unique, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    comment: str | None = None

    @property
    def columns(self) -> list[str]:
        return [c.name for c in self.definitions]

    def column(self, name: str) -> Column:
        for c in self.definitions:
            if c.name.lower() == name.lower():
                return c
        raise QueryError(f"Table {self.name} has no column {name}")

    @property
    def keys(self) -> list[Unique]:
        own = [Unique(f"{self.name}_pkey", self.primary_key)] if self.primary_key else []
        return [*own, *self.uniques]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, T._parse_datatype_string(c.spark)) for c in self.definitions])


@dataclass
class Version:
    """Where the rows are: a frame that is read only, or Parquet files."""

    frame: DataFrame | None = None
    files: tuple[str, ...] = field(default_factory=tuple)


class Store:
    """The tables of an engine, known as temporary views of the same names to a session that no other engine uses."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self._views: set[str] = set()
        self._root = root
        self.tables: dict[str, Table] = {}
        self.versions: dict[str, Version] = {}
        self._pending: dict[str, str] = {}
        self._loaded: dict[str, Version] = {}
        self._paths: dict[str, str] = {}
        self._serials: dict[tuple[str, str], int] = {}
        self.deferred: set[str] | None = set()  # names of constraints that wait for commit; None: all that can

    @property
    def root(self) -> str:
        """The folder of all versions: given, or in the shared folder, or a temporary one for a local master."""
        if self._root is None:
            shared = self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.sparkContext.getCheckpointDir()
            if not shared:
                if not self.spark.sparkContext.master.startswith("local"):
                    raise QueryError("Stored tables need a folder that all executors share")
                shared = tempfile.mkdtemp(prefix="quern-store-")
            self._root = f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        return self._root

    def close(self) -> None:
        """Drops all tables and views, and the folder of their versions."""
        for name in list(self.tables):
            self.drop(name)
        for view in self._views:
            self.spark.catalog.dropTempView(view)
        self._views.clear()
        self._pending.clear()
        if self._root is not None:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    # views
    def view(self, frame: DataFrame, name: str | None = None) -> str:
        """A frame as a view of the store's session."""
        name = name or f"quern_view_{uuid.uuid4().hex}"
        if frame.sparkSession is not self.spark:  # a union belongs to the session of its first frame
            empty = ", ".join(f"cast(null as {f.dataType.simpleString()}) as `c{k}`" for k, f in enumerate(frame.schema))
            frame = self.spark.sql(f"select {empty} where false").union(frame).toDF(*frame.columns)
        frame.createOrReplaceTempView("`" + name + "`")
        self._views.add(name)
        return name

    def forget(self, view: str) -> None:
        self.spark.catalog.dropTempView(view)
        self._views.discard(view)

    # declaring
    def register(self, name: str, frame: DataFrame, primary_key: Sequence[str] = (), **more: Any) -> Table:
        """A read-only frame as a table; the first change that rewrites rows copies it."""
        columns = tuple(Column(f.name, _sql_type(f.dataType)) for f in frame.schema)
        table = Table(name, columns, tuple(primary_key), **more)
        self.tables[name], self.versions[name] = table, Version(frame=frame)
        self._show(name)
        return table

    def declare(self, name: str, path: str) -> None:
        """A Parquet table that is read when a statement first names it; changes keep those of its files that they don't touch."""
        self._pending[name] = self._paths[name] = path

    def source(self, name: str, kind: str, path: str | None = None, schema: str | None = None, **options: Any) -> Table:
        """A table of any format that Spark reads: csv, json, orc, text, jdbc with url and dbtable, and so on."""
        reader = self.spark.read.format(kind).options(**options)
        reader = reader.schema(schema) if schema else reader
        return self.register(name, reader.load(path) if path else reader.load())

    def load(self, name: str) -> None:
        if (path := self._pending.pop(name, None)) is not None:
            frame = self.spark.read.parquet(path)
            columns = tuple(Column(f.name, _sql_type(f.dataType)) for f in frame.schema)
            self.tables[name], self.versions[name] = Table(name, columns), Version(files=_files(frame))
            self._show(name, frame)
            self._loaded[name] = self.versions[name]

    def load_named(self, text: str) -> None:
        """Loads the declared tables whose names occur in a statement."""
        if self._pending:
            for word in set(re.findall(r"\w+", text)).intersection(self._pending):
                self.load(word)

    def load_all(self) -> Store:
        for name in list(self._pending):
            self.load(name)
        return self

    def create(
        self,
        name: str,
        columns: Mapping[str, str],
        *,
        primary_key: Sequence[str] = (),
        unique: Mapping[str, Sequence[str]] | None = None,
        deferrable: Sequence[str] = (),
        foreign_keys: Mapping[str, tuple[Sequence[str], str, Sequence[str]]] | None = None,
        defaults: Mapping[str, str] | None = None,
    ) -> Table:
        """A new empty table. Types may end in NOT NULL; serial types fill themselves."""
        defaults, made = dict(defaults or {}), []
        for column, kind in columns.items():
            plain = re.sub(r"\s+not null$", "", kind.strip(), flags=re.I)
            serial = "serial" in plain.lower()
            strict = plain != kind.strip() or serial or column in primary_key
            made.append(Column(column, canonical(plain), not strict, serial, defaults.get(column)))
        uniques = tuple(Unique(n, tuple(c), n in deferrable) for n, c in (unique or {}).items())
        keys = tuple(ForeignKey(n, tuple(c), t, tuple(tc), n in deferrable) for n, (c, t, tc) in (foreign_keys or {}).items())
        table = Table(name, tuple(made), tuple(primary_key), uniques, keys)
        self.tables[name], self.versions[name] = table, Version()
        self._show(name)
        return table

    def constrain(self, name: str, **changes: Any) -> Table:
        """Declares more about a table: primary_key, uniques, foreign_keys."""
        self.tables[name] = replace(self.get(name), **changes)
        return self.tables[name]

    def drop(self, name: str) -> None:
        self.get(name)
        del self.tables[name], self.versions[name]
        self.forget(name)

    def path_of(self, name: str) -> str | None:
        """Where a declared table is read from."""
        return self._paths.get(name)

    def find(self, name: str) -> Table | None:
        self.load(name)
        return self.tables.get(name)

    def get(self, name: str) -> Table:
        self.load(name)
        if name not in self.tables:
            raise TableDoesNotExist(f"Table {name} does not exist", sqlstate="42P01")
        return self.tables[name]

    # reading
    def read(self, name: str, files: Sequence[str]) -> DataFrame:
        """Rows of files, with their places."""
        shape = self.get(name).schema
        if not files:
            return self.spark.createDataFrame([], T.StructType([*shape.fields, T.StructField(FILE, T.StringType()), T.StructField(PLACE, T.LongType())]))
        rows = self.spark.read.schema(shape).parquet(*files)
        return rows.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE))

    def rows(self, name: str) -> DataFrame:
        """The current rows with their places; a frame that was registered is written first."""
        self.get(name)
        if (frame := self.versions[name].frame) is not None:
            self.versions[name] = Version(files=self._write(name, frame))
        return self.read(name, self.versions[name].files)

    def same_files(self, name: str, files: Sequence[str]) -> list[str]:
        """The files of the current version that these are."""
        wanted = {_plain_path(f) for f in files}
        return [f for f in self.versions[name].files if _plain_path(f) in wanted]

    def frame(self, name: str) -> DataFrame:
        version = self.versions[name]
        return version.frame if version.frame is not None else self._plain(name, version.files)

    def _plain(self, name: str, files: Sequence[str]) -> DataFrame:
        shape = self.get(name).schema
        return self.spark.read.schema(shape).parquet(*files) if files else self.spark.createDataFrame([], shape)

    def _show(self, name: str, frame: DataFrame | None = None) -> None:
        self.view(frame if frame is not None else self.frame(name), name)

    # writing
    def _write(self, name: str, rows: DataFrame) -> tuple[str, ...]:
        """Writes rows of the table's columns; gives the files."""
        folder = f"{self.root}/{uuid.uuid4().hex}"
        shape = [F.col(f"`{c.name}`").cast(c.spark).alias(c.name) for c in self.get(name).definitions]
        rows.select(*shape).write.parquet(folder)
        return _files(self.spark.read.schema(self.get(name).schema).parquet(folder))

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Adds rows; gives them back as they were written."""
        before = self.versions[name]
        new = self._write(name, rows)
        came = self._plain(name, new)
        if before.frame is not None:
            self.rows(name)
        self.versions[name] = Version(files=(*self.versions[name].files, *new))
        self._checked(name, before, came, None, None)
        return came

    def rewrite(self, name: str, touched: Sequence[str], rows: DataFrame, came: DataFrame | None, went: DataFrame | None, columns: Sequence[str] | None) -> None:
        """Puts rows in the place of those of the touched files. Came and went are the new and old images of changed rows, columns what changed in them."""
        before = self.versions[name]
        gone = {_plain_path(f) for f in touched}
        kept = tuple(f for f in before.files if _plain_path(f) not in gone)
        self.versions[name] = Version(files=(*kept, *self._write(name, rows)))
        self._checked(name, before, came, went, columns)

    def _checked(self, name: str, before: Version, came: DataFrame | None, went: DataFrame | None, columns: Sequence[str] | None) -> None:
        try:
            self.check_change(name, came, went, columns)
        except Exception:
            self.versions[name] = before
            self._show(name)
            raise
        self._show(name)

    # serials
    def next_serials(self, table: str, column: str, count: int) -> int:
        """Takes count numbers and gives the first."""
        key = (table, column)
        if key not in self._serials:
            top = self.frame(table).agg(F.max(F.col(f"`{column}`"))).first()[0]
            self._serials[key] = (top or 0) + 1
        first = self._serials[key]
        self._serials[key] += count
        return first

    # constraints
    def _waits(self, name: str, deferrable: bool) -> bool:
        return deferrable and (self.deferred is None or name in self.deferred)

    def within(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """The rows whose columns are among keys. These are broadcast up to a counted size, so that the rows stay where they are."""
        if keys.count() <= BROADCAST_ROWS:
            keys = F.broadcast(keys)
        return rows.join(keys, keys.columns, "left_semi")

    def check_change(self, name: str, came: DataFrame | None, went: DataFrame | None, columns: Sequence[str] | None = None) -> None:
        """Raises the violation of the first constraint that a change has broken, given that all held before."""
        table = self.get(name)
        changed = {c.lower() for c in (columns if columns is not None else table.columns)}

        def concerned(names: Sequence[str]) -> bool:
            return any(n.lower() in changed for n in names)

        if came is not None:
            strict = [c.name for c in table.definitions if not c.nullable and concerned([c.name])]
            if strict:
                found = came.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in strict]).first()
                for c in strict:
                    if found[c]:
                        raise NotNullViolation(f"Null in {table.name}.{c}", c)
            for key in table.keys:
                if concerned(key.columns) and not self._waits(key.name, key.deferrable):
                    own = came.select(*[F.col(f"`{c}`") for c in key.columns]).dropna().distinct()
                    again = self.within(self.frame(name).select(*[F.col(f"`{c}`") for c in key.columns]), own)
                    if not again.groupBy(*again.columns).count().where("count > 1").isEmpty():
                        raise UniqueViolation(f"Two rows of {table.name} have the same {', '.join(key.columns)}", key.name)
            for key in table.foreign_keys:
                if concerned(key.columns) and not self._waits(key.name, key.deferrable):
                    own = _keyed(came, key.columns).dropna().distinct()
                    there = self.within(_keyed(self.frame(key.target), key.target_columns), own).distinct()
                    if not own.join(there, own.columns, "left_anti").isEmpty():
                        raise ForeignKeyViolation(f"{table.name} refers to a missing row of {key.target}", key.name)
        if went is not None:
            for owner in self.tables.values():
                for key in owner.foreign_keys:
                    if key.target == table.name and concerned(key.target_columns) and not self._waits(key.name, key.deferrable):
                        old = _keyed(went, key.target_columns).dropna().distinct()
                        left = self.within(_keyed(self.frame(name), key.target_columns), old).distinct()
                        lost = old.join(left, old.columns, "left_anti")
                        if not self.within(_keyed(self.frame(owner.name), key.columns), lost).isEmpty():
                            raise ForeignKeyViolation(f"{owner.name} refers to a missing row of {key.target}", key.name)

    def check(self, name: str, at_commit: bool = False) -> None:
        """Raises the violation of the first constraint that does not hold, from all rows: what waited, at commit."""
        table, rows = self.get(name), self.frame(name)
        strict = [c.name for c in table.definitions if not c.nullable]
        if strict:
            found = rows.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in strict]).first()
            for c in strict:
                if found[c]:
                    raise NotNullViolation(f"Null in {table.name}.{c}", c)
        for key in table.keys:
            if at_commit or not self._waits(key.name, key.deferrable):
                columns = [F.col(f"`{c}`") for c in key.columns]
                again = rows.dropna(subset=list(key.columns)).groupBy(*columns).count().where("count > 1")
                if not again.isEmpty():
                    raise UniqueViolation(f"Two rows of {table.name} have the same {', '.join(key.columns)}", key.name)
        for owner in self.tables.values():
            for key in owner.foreign_keys:
                if table.name in (owner.name, key.target) and (at_commit or not self._waits(key.name, key.deferrable)):
                    left = _keyed(self.frame(owner.name), key.columns).dropna()
                    right = _keyed(self.frame(key.target), key.target_columns)
                    if not left.join(right, left.columns, "left_anti").isEmpty():
                        raise ForeignKeyViolation(f"{owner.name} refers to a missing row of {key.target}", key.name)

    # snapshots
    def snapshot(self) -> dict[str, Version]:
        return dict(self.versions)

    def restore(self, snapshot: dict[str, Version]) -> None:
        """Back to a snapshot; serial numbers that were taken stay taken."""
        for name in self.tables:
            version = snapshot.get(name, self._loaded.get(name))
            if version is not None and self.versions[name] is not version:
                self.versions[name] = version
                self._show(name)


def _keyed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(columns)])


def _files(frame: DataFrame) -> tuple[str, ...]:
    return tuple(sorted(unquote(f) for f in frame.inputFiles()))


def _plain_path(file: str) -> str:
    """A path in one spelling: Spark writes some with an escape or with more slashes than others."""
    return re.sub(r"^file:/+", "/", unquote(file))


def _sql_type(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return _sql_type(kind.elementType) + "[]"
    simple = kind.simpleString()
    names = {"int": "integer", "string": "varchar", "binary": "bytea", "timestamp_ntz": "timestamp", "timestamp": "timestamptz", "float": "real", "tinyint": "smallint"}
    return names.get(simple, simple)
