"""Query builders. Each writes itself as one Spark SQL statement, or, where it changes data, is run by operators.dml."""

from __future__ import annotations

import copy
import enum
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from quern.errors import QueryError
from quern.plans.expressions import (
    Aggregate, ColumnRef, Expression, Groups, Raw, Scope, Statement, TableRef, Values, Window, as_column, as_raw, as_value, called,
)
from quern.plans.fragments import EMPTY, Fragment, glued, joined, quoted
from quern.plans.where import Where


class JoinMode(enum.Enum):
    NATURAL = "natural inner join"
    INNER = "inner join"
    LEFT = "left outer join"
    RIGHT = "right outer join"
    FULL = "full outer join"
    CROSS = "cross join"
    SEMI = "left semi join"
    ANTI = "left anti join"


class Order(enum.Enum):
    ASC = "asc"
    DESC = "desc"


class Nulls(enum.Enum):
    """Where nulls stand; the default is last for ascending and first for descending order."""

    DEFAULT = ""
    FIRST = "nulls first"
    LAST = "nulls last"


@dataclass
class Projection:
    expression: Expression
    alias: str | None = None

    def write(self, scope: Scope) -> Fragment:
        out = self.expression.operand(scope)
        if self.alias is None or (isinstance(self.expression, ColumnRef) and self.expression.name in ("*", self.alias)):
            return out
        return Fragment(f"{out.text} as {quoted(self.alias)}", out.values)


@dataclass
class Source:
    """A table expression under the name by which the query knows it."""

    expression: Expression
    alias: str

    def write(self, scope: Scope) -> Fragment:
        return self.expression.as_table(scope) + f" as {quoted(self.alias)}"


@dataclass
class Join:
    mode: JoinMode
    source: Source
    condition: Expression | None
    using: tuple[str, ...] = ()
    lateral: bool = False

    def write(self, scope: Scope) -> Fragment:
        if self.using:
            return f"{self.mode.value} " + self.source.write(scope) + f" using ({', '.join(map(quoted, self.using))})"
        if self.lateral:
            return f"{self.mode.value} lateral " + self.source.write(scope) + (" on true" if self.mode is JoinMode.LEFT else "")
        if isinstance(self.condition, Raw):
            return glued([self.mode.value, " ", self.source.write(scope), " on ", self.condition.write(scope)]) if self.mode.value[0] not in "nc" else self._plain(scope)
        return self._plain(scope)

    def _plain(self, scope: Scope) -> Fragment:
        bare = self.condition is None or (isinstance(self.condition, Where) and not self.condition)
        mode = JoinMode.CROSS if bare and self.mode is JoinMode.INNER else self.mode
        out = f"{mode.value} " + self.source.write(scope)
        if self.condition is None or bare or mode in (JoinMode.NATURAL, JoinMode.CROSS):
            return out + (" on true" if bare and mode not in (JoinMode.NATURAL, JoinMode.CROSS) else "")
        return out + " on " + self.condition.write(scope)


@dataclass
class With:
    alias: str
    expression: Expression
    recursive: bool = False
    columns: list[str] = field(default_factory=list)

    def write(self, scope: Scope) -> Fragment:
        names = self.columns or (self.expression.names if isinstance(self.expression, Values) else [])
        head = quoted(self.alias) + (f"({', '.join(map(quoted, names))})" if names else "")
        return Fragment(f"{head} as (") + self.expression.write(scope) + ")"


class Query(Expression):
    """What all builders share: an engine to run on, options, an identifier, WITH, and alias bookkeeping."""

    returns_rows = False

    def __init__(self) -> None:
        self._engine: Any = None
        self.options: dict[str, Any] = {}
        self.identifier: str | None = None
        self._with: list[With] = []
        self._aliases: dict[str, Statement | None] = {}

    def bind(self, engine: Any) -> Any:
        self._engine = engine
        return self

    def option(self, name: str, value: Any) -> Any:
        self.options[name] = value
        return self

    def identified(self, name: str) -> Any:
        self.identifier = name
        return self

    def _need(self) -> Any:
        if self._engine is None:
            raise QueryError("This query has no engine to run on")
        return self._engine

    def execute(self, arguments: Any = None, options: Mapping[str, Any] | None = None) -> Any:
        """The result. Arguments, if there are any, replace all values of the builder."""
        return self._need().execute(self, arguments, options)

    def perform(self, arguments: Any = None, options: Mapping[str, Any] | None = None) -> int:
        """The number of affected rows."""
        return self._need().perform(self, arguments, options)

    def frame(self) -> Any:
        """The DataFrame of this query."""
        return self._need().frame(self)

    def copy(self) -> Any:
        out = copy.copy(self)
        for name, value in vars(self).items():
            if isinstance(value, Where):
                setattr(out, name, value.copy())
            elif isinstance(value, (list, dict)):
                setattr(out, name, copy.copy(value))
        return out

    # WITH
    def with_(self, alias: str, expression: Any, recursive: bool = False, columns: Sequence[str] = ()) -> Any:
        expression = called(expression)
        if isinstance(expression, str):
            expression = Raw(expression)
        self._with.append(With(alias, expression, recursive, list(columns)))
        return self

    def create_with(self, alias: str, table: Any = None, table_alias: str | None = None) -> Select:
        inner = Select(table, table_alias).bind(self._engine)
        self.with_(alias, inner)
        return inner

    def _write_with(self, scope: Scope) -> Fragment:
        if not self._with:
            return EMPTY
        word = "with recursive " if any(w.recursive for w in self._with) else "with "
        return word + joined(", ", (w.write(scope) for w in self._with)) + " "

    # names of tables
    def _source(self, table: Any, alias: str | None = None) -> Source:
        table = called(table, self)
        if table is None or table == "":
            raise QueryError("Expression cannot be null or empty")
        if isinstance(table, Source):
            table, alias = table.expression, alias or table.alias
        expression = TableRef(table) if isinstance(table, str) else table
        wanted = alias or getattr(expression, "alias", None)
        if wanted is not None:
            if wanted in self._aliases:
                raise QueryError(f"Alias {wanted!r} is already used")
            name = wanted
        else:
            name = expression.default_alias or self._fresh()
            name = self._fresh() if name in self._aliases else name
        self._aliases[name] = expression
        return Source(expression, name)

    def _fresh(self) -> str:
        k = 1
        while f"quern_{k}" in self._aliases:
            k += 1
        return f"quern_{k}"


class _Filtered(Query):
    """WHERE and the table list with joins."""

    def __init__(self) -> None:
        super().__init__()
        self._where = Where()
        self._from: list[Source] = []
        self._joins: list[Join] = []

    def get_where(self) -> Where:
        return self._where

    def where(self, column: Any, value: Any = None, operator: str = "=") -> Any:
        self._where.condition(column, value, operator)
        return self

    def where_expression(self, expression: Any, arguments: Any = ()) -> Any:
        self._where.expression(expression, arguments)
        return self

    def where_or(self, callback: Any = None) -> Any:
        found = self._where.or_(callback)
        return self if callback is not None else found

    def where_and(self, callback: Any = None) -> Any:
        found = self._where.and_(callback)
        return self if callback is not None else found

    def from_(self, table: Any, alias: str | None = None) -> Any:
        self._from.append(self._source(table, alias))
        return self

    def join(self, table: Any, condition: Any = None, alias: str | None = None, mode: JoinMode = JoinMode.INNER) -> Any:
        source = self._source(table, alias)
        if condition is not None:
            if callable(condition) and not isinstance(condition, (Statement, str)):
                own = Where()
                found = condition(own)
                condition = own if found is None else found
            if isinstance(condition, str):
                condition = Raw(condition)
            if not isinstance(condition, (Raw, Where)):
                raise QueryError("A join's condition is SQL text, a raw expression or a predicate tree")
        self._joins.append(Join(mode, source, condition))
        return self

    def join_using(self, table: Any, columns: Sequence[str], alias: str | None = None, mode: JoinMode = JoinMode.INNER) -> Any:
        """Rows that agree in columns of these names, which the result has once."""
        if not columns or mode in (JoinMode.NATURAL, JoinMode.CROSS):
            raise QueryError("A join by names needs columns, and a mode that has a condition")
        self._joins.append(Join(mode, self._source(table, alias), None, tuple(columns)))
        return self

    def join_lateral(self, query: Any, alias: str | None = None, left: bool = False) -> Any:
        """Each row with the rows that a query, which may name tables before it, gives for it."""
        self._joins.append(Join(JoinMode.LEFT if left else JoinMode.CROSS, self._source(query, alias), None, lateral=True))
        return self

    def join_where(self, table: Any, alias: str | None = None, mode: JoinMode = JoinMode.INNER) -> Where:
        where = Where()
        self.join(table, where, alias, mode)
        return where

    def inner_join(self, table: Any, condition: Any = None, alias: str | None = None) -> Any:
        return self.join(table, condition, alias, JoinMode.INNER)

    def inner_join_where(self, table: Any, alias: str | None = None) -> Where:
        return self.join_where(table, alias, JoinMode.INNER)

    def left_join(self, table: Any, condition: Any = None, alias: str | None = None) -> Any:
        return self.join(table, condition, alias, JoinMode.LEFT)

    def left_join_where(self, table: Any, alias: str | None = None) -> Where:
        return self.join_where(table, alias, JoinMode.LEFT)

    def right_join(self, table: Any, condition: Any = None, alias: str | None = None) -> Any:
        return self.join(table, condition, alias, JoinMode.RIGHT)

    def natural_join(self, table: Any, alias: str | None = None) -> Any:
        return self.join(table, None, alias, JoinMode.NATURAL)

    def _write_sources(self, scope: Scope) -> Fragment:
        """Several tables are a product that WHERE narrows; Catalyst makes joins of it."""
        out = joined(" cross join ", [s.write(scope) for s in self._from])
        return joined(" ", [out, *[j.write(scope) for j in self._joins]]) if self._joins else out


class _Returning(Query):
    def __init__(self) -> None:
        super().__init__()
        self._returning: list[Projection] = []

    def returning(self, expression: Any = "*", alias: str | None = None) -> Any:
        self._returning.append(Projection(as_column(expression), alias))
        return self

    def returning_expression(self, sql: Any, alias: str | None = None, arguments: Any = ()) -> Any:
        self._returning.append(Projection(as_raw(sql, arguments), alias))
        return self

    def remove_returning(self, alias: str) -> Any:
        self._returning = [p for p in self._returning if p.alias != alias]
        return self

    @property
    def returns_rows(self) -> bool:  # type: ignore[override]
        return bool(self._returning)


class Select(_Filtered):
    """SELECT."""

    returns_rows = True

    def __init__(self, table: Any = None, alias: str | None = None):
        super().__init__()
        self._columns: list[Projection] = []
        self._groups: list[Expression] = []
        self._having = Where()
        self._orders: list[tuple[Expression, Order, Nulls]] = []
        self._limit = self._offset = 0
        self._sets: list[tuple[str, Expression]] = []
        self._hints: list[str] = []
        self._distinct = self._perform_only = False
        self.locked_for_update = False
        if table is not None:
            self.from_(table, alias)

    # projection
    def column(self, expression: Any, alias: str | None = None) -> Select:
        self._columns.append(Projection(as_column(expression, self), alias if not isinstance(alias, int) else None))
        return self

    def columns(self, columns: Mapping[Any, Any] | Sequence[Any]) -> Select:
        items = columns.items() if isinstance(columns, Mapping) else enumerate(columns)
        for key, value in items:
            self.column(value, key if isinstance(key, str) else None)
        return self

    def column_expression(self, sql: Any, alias: str | None = None, arguments: Any = ()) -> Select:
        self._columns.append(Projection(as_raw(sql, arguments, self), alias))
        return self

    def column_value(self, value: Any, alias: str, sql_type: str | None = None) -> Select:
        self._columns.append(Projection(as_value(value, sql_type), alias))
        return self

    def column_aggregate(self, name: str, columns: Any = (), alias: str | None = None, distinct: bool = False, where: Any = None) -> Select:
        """An aggregate, exact or approximate: its name as in Spark. Where is a predicate tree, or a callable that fills one."""
        if callable(where) and not isinstance(where, Statement):
            own = Where()
            where = called(where, own) or own
        columns = columns if isinstance(columns, (list, tuple)) else [columns]
        return self.column(Aggregate(name, *columns, distinct=distinct, where=where), alias)

    def column_window(
        self, function: Any, alias: str | None = None, partition_by: Sequence[Any] = (), order_by: Sequence[Any] = (),
        frame: tuple[str, int | None, int | None] | None = None,
    ) -> Select:
        """A ranking, analytic or aggregate function over a window."""
        return self.column(Window(function, partition_by, order_by, frame), alias)

    def _find(self, alias: str) -> int | None:
        for k, p in enumerate(self._columns):
            if alias == p.alias or (p.alias is None and isinstance(p.expression, ColumnRef) and alias in (p.expression.name, f"{p.expression.table}.{p.expression.name}")):
                return k
        return None

    def has_column(self, alias: str) -> bool:
        return self._find(alias) is not None

    def remove_column(self, alias: str) -> Select:
        if (k := self._find(alias)) is not None:
            del self._columns[k]
        return self

    def remove_all_columns(self) -> Select:
        self._columns.clear()
        return self

    def distinct(self) -> Select:
        self._distinct = True
        return self

    # groups
    def group_by(self, expression: Any) -> Select:
        self._groups.append(as_column(expression, self))
        return self

    def group_by_expression(self, sql: Any, arguments: Any = ()) -> Select:
        self._groups.append(as_raw(sql, arguments, self))
        return self

    def rollup(self, *columns: Any) -> Select:
        """Groups by all columns, by all but the last, and so on down to none."""
        self._groups.append(Groups("rollup", columns))
        return self

    def cube(self, *columns: Any) -> Select:
        """Groups by each set of the columns."""
        self._groups.append(Groups("cube", columns))
        return self

    def grouping_sets(self, *sets: Sequence[Any]) -> Select:
        self._groups.append(Groups("grouping sets", sets))
        return self

    def get_having(self) -> Where:
        return self._having

    def having(self, column: Any, value: Any = None, operator: str = "=") -> Select:
        self._having.condition(column, value, operator)
        return self

    def having_expression(self, expression: Any, arguments: Any = ()) -> Select:
        self._having.expression(expression, arguments)
        return self

    def having_or(self, callback: Any = None) -> Any:
        found = self._having.or_(callback)
        return self if callback is not None else found

    def having_and(self, callback: Any = None) -> Any:
        found = self._having.and_(callback)
        return self if callback is not None else found

    # order and range
    def order_by(self, column: Any, order: Order = Order.ASC, nulls: Nulls = Nulls.DEFAULT) -> Select:
        self._orders.append((as_column(column, self), order, nulls))
        return self

    def order_by_expression(self, sql: Any, order: Order = Order.ASC, nulls: Nulls = Nulls.DEFAULT, arguments: Any = ()) -> Select:
        self._orders.append((as_raw(sql, arguments, self), order, nulls))
        return self

    def remove_all_order(self) -> Select:
        self._orders.clear()
        return self

    def range(self, limit: int = 0, offset: int = 0) -> Select:
        """0 is no limit or no offset."""
        if limit < 0 or offset < 0:
            raise QueryError("Limit and offset are not negative")
        self._limit, self._offset = limit, offset
        return self

    def page(self, limit: int, page: int = 1) -> Select:
        if page < 1:
            raise QueryError("Pages are counted from 1")
        return self.range(limit, (page - 1) * limit)

    @property
    def limits(self) -> tuple[int, int]:
        return self._limit, self._offset

    # sets
    def _set(self, word: str, query: Any) -> Select:
        query = called(query)
        self._sets.append((word, Raw(query) if isinstance(query, str) else query))
        return self

    def union(self, query: Any) -> Select:
        return self._set("union", query)

    def create_union(self, table: Any = None, alias: str | None = None) -> Select:
        inner = Select(table, alias).bind(self._engine)
        self.union(inner)
        return inner

    def union_all(self, query: Any) -> Select:
        return self._set("union all", query)

    def intersect(self, query: Any) -> Select:
        return self._set("intersect", query)

    def except_(self, query: Any) -> Select:
        return self._set("except", query)

    # execution flags
    def hint(self, name: str, *aliases: str) -> Select:
        """Advice for Spark's planner, such as how to join tables of these aliases; the rows are the same without it."""
        if not name.isidentifier():
            raise QueryError(f"{name!r} is no name of a hint")
        self._hints.append(name + (f"({', '.join(map(quoted, aliases))})" if aliases else ""))
        return self

    def for_update(self) -> Select:
        """Kept as a flag: a snapshot store takes no row locks."""
        self.locked_for_update = True
        return self

    def perform_only(self) -> Select:
        self._perform_only = True
        self.returns_rows = False
        return self

    def count_query(self, alias: str = "count") -> Select:
        """The same rows counted: without projection, order and range. A grouped query gives the number of its groups."""
        out = self.copy()
        out._columns, out._orders = [], []
        out.range()
        if out._groups or out._sets or out._distinct or out._having:
            inner = out
            inner._columns = list(self._columns) if self._sets or self._distinct else []
            if not inner._columns:
                inner._columns = [Projection(Raw("1"), "one")]
            out = Select(inner, "counted").bind(self._engine)
        return out.column_expression("count(*)", alias)

    # writing
    def _projected(self, scope: Scope) -> Fragment:
        if not self._columns:
            return self._star(scope, None) or Fragment("*")
        if not self._groups:
            return joined(", ", [p.write(scope) for p in self._columns])
        return joined(", ", [self._one(p, scope) for p in self._columns])

    def _one(self, p: Projection, scope: Scope) -> Fragment:
        e = p.expression
        if isinstance(e, ColumnRef) and self._groups and scope.tables is not None:
            if e.name == "*":
                return self._star(scope, e.table) or p.write(scope)
            found = self._keyed(e.table, scope)
            if found and not self._is_group(e):
                return "any_value(" + e.write(scope) + f") as {quoted(p.alias or e.name)}"
        return p.write(scope)

    def _is_group(self, column: ColumnRef) -> bool:
        return any(isinstance(g, ColumnRef) and g.name == column.name and (g.table == column.table or None in (g.table, column.table)) for g in self._groups)

    def _keyed(self, alias: str | None, scope: Scope) -> list[str] | None:
        """Columns of the table of that alias, if the groups hold its whole primary key."""
        if scope.tables is None:
            return None
        sources = [*self._from, *(j.source for j in self._joins)]
        for s in sources:
            if (s.alias == alias or (alias is None and len(sources) == 1)) and isinstance(s.expression, TableRef):
                found = scope.tables.find(s.expression.key)
                if found and found.primary_key and all(self._is_group(ColumnRef(c, s.alias)) for c in found.primary_key):
                    return found.columns
        return None

    def _star(self, scope: Scope, alias: str | None) -> Fragment | None:
        """The columns that a star stands for under GROUP BY of a primary key."""
        if not self._groups:
            return None
        names = [s.alias for s in [*self._from, *(j.source for j in self._joins)]] if alias is None else [alias]
        out = []
        for name in names:
            columns = self._keyed(name, scope)
            if columns is None:
                return None
            for c in columns:
                ref = ColumnRef(c, name)
                out.append(ref.write(scope) if self._is_group(ref) else "any_value(" + ref.write(scope) + f") as {quoted(c)}")
        return joined(", ", out)

    def _block(self, scope: Scope) -> Fragment:
        out: list[Fragment | str] = ["select ", f"/*+ {', '.join(self._hints)} */ " if self._hints else "", "distinct " if self._distinct else "", self._projected(scope)]
        if self._from:
            out += [" from ", self._write_sources(scope)]
        elif self._joins:
            raise QueryError("A join needs a table to join to")
        if self._where:
            out += [" where ", self._where.write(scope)]
        if self._groups:
            out += [" group by ", joined(", ", [g.operand(scope) for g in self._groups])]
        if self._having:
            out += [" having ", self._having.write(scope)]
        if self._orders:
            out += [" order by ", joined(", ", [_ordered(*o, scope) for o in self._orders])]
        if self._limit:
            out.append(f" limit {self._limit}")
        if self._offset:
            out.append(f" offset {self._offset}")
        return glued(out)

    def write(self, scope: Scope) -> Fragment:
        out = self._block(scope)
        if self._sets:
            out = "(" + out + ")" if self._orders or self._limit or self._offset else out
            for word, query in self._sets:
                out = out + f" {word} " + "(" + query.write(scope) + ")"
        return self._write_with(scope) + out if self._with else out

    def operand(self, scope: Scope) -> Fragment:
        return "(" + self.write(scope) + ")"


def _ordered(expression: Expression, order: Order, nulls: Nulls, scope: Scope) -> Fragment:
    return expression.operand(scope) + _DIRECTIONS[order, nulls]


_DIRECTIONS = {(o, n): f" {o.value} {n.value or ('nulls last' if o is Order.ASC else 'nulls first')}" for o in Order for n in Nulls}


class RawQuery(Query):
    """A whole statement as text."""

    returns_rows = True

    def __init__(self, sql: str, arguments: Any = ()):
        super().__init__()
        self._raw = Raw(sql, arguments)

    def write(self, scope: Scope) -> Fragment:
        return self._raw.write(scope)

    def operand(self, scope: Scope) -> Fragment:
        return "(" + self.write(scope) + ")"


class _Written(_Returning):
    """INSERT and MERGE: a target, columns, and rows from values or a query."""

    def __init__(self, table: Any, alias: str | None = None):
        super().__init__()
        self.target = self._source(table, alias)
        if not isinstance(self.target.expression, TableRef):
            raise QueryError("Data is written to a named table")
        self._names: list[str] | None = None
        self._rows: Values | None = None
        self._query: Expression | None = None

    def columns(self, names: Sequence[str]) -> Any:
        if self._names is not None:
            raise QueryError("The columns are already set")
        self._names = list(names)
        return self

    def values(self, values: Any) -> Any:
        if self._query is not None:
            raise QueryError("Values and a query exclude each other")
        values = called(values)
        if self._rows is None:
            self._rows = Values()
        if isinstance(values, Mapping) and self._names is None:
            self._names = list(values)
        self._rows.row(values)
        return self

    def query(self, query: Any) -> Any:
        if self._rows is not None or self._query is not None:
            raise QueryError("Values and a query exclude each other")
        query = called(query)
        if isinstance(query, Values) and self._names is None and query._names:
            self._names = query.names
        self._query = query
        return self

    def get_query(self) -> Expression | None:
        return self._query if self._query is not None else self._rows

    @property
    def names(self) -> list[str] | None:
        return self._names


class Insert(_Written):
    """INSERT; without values or query, a row of defaults."""


class Merge(_Written):
    """Rows that meet no existing row are inserted; the others are left alone or updated."""

    def __init__(self, table: Any, alias: str | None = None):
        super().__init__(table, alias)
        self._key: list[str] = []
        self.update: bool | None = None
        self.using_alias = "upsert"

    def set_key(self, columns: Sequence[str] | str) -> Merge:
        columns = [columns] if isinstance(columns, str) else list(columns)
        if any(not isinstance(c, str) or "." in c for c in columns):
            raise QueryError("Key columns are names without a table")
        self._key = columns
        return self

    @property
    def key(self) -> list[str]:
        return self._key

    def set_using_alias(self, alias: str) -> Merge:
        self.using_alias = alias
        return self

    def on_conflict_ignore(self) -> Merge:
        self.update = False
        return self

    def on_conflict_update(self, key: Sequence[str] | str | None = None) -> Merge:
        self.update = True
        return self if key is None else self.set_key(key)

    def on_conflict(self, mode: str) -> Merge:
        if mode not in ("ignore", "update"):
            raise QueryError(f"Unknown conflict mode {mode!r}")
        return self.on_conflict_update() if mode == "update" else self.on_conflict_ignore()


class Update(_Returning, _Filtered):
    """UPDATE, with more tables to join."""

    def __init__(self, table: Any, alias: str | None = None):
        super().__init__()
        self.target = self._source(table, alias)
        self.changes: dict[str, Expression] = {}

    def set(self, column: str, value: Any) -> Update:
        if not isinstance(column, str) or not column or "." in column:
            raise QueryError("A column to set is a name without a table")
        self.changes[column] = as_value(value)
        return self

    def sets(self, values: Mapping[str, Any]) -> Update:
        for column, value in values.items():
            self.set(column, value)
        return self


class Delete(_Returning, _Filtered):
    """DELETE, with more tables to join."""

    def __init__(self, table: Any, alias: str | None = None):
        super().__init__()
        self.target = self._source(table, alias)


class Prepared(Query):
    """A query whose builder runs once, and whose values may be replaced at each execution."""

    returns_rows = True

    def __init__(self, engine: Any, callback: Any, identifier: str | None = None):
        super().__init__()
        self.bind(engine)
        self._callback, self.identifier, self._built = callback, identifier, None

    def built(self) -> Any:
        if self._built is None:
            found = self._callback(self._engine)
            if isinstance(found, str):
                found = RawQuery(found)
            if isinstance(found, Prepared):
                raise QueryError("A prepared query can't hold another")
            if not isinstance(found, Query):
                raise QueryError("The callback gives no query")
            self._built = found.bind(self._engine)
        return self._built

    def _fixed(self, *_: Any, **__: Any) -> Any:
        raise QueryError("A prepared query can't be changed")

    option = identified = with_ = create_with = _fixed

    def write(self, scope: Scope) -> Fragment:
        return self.built().write(scope)

    def perform(self, arguments: Any = None, options: Mapping[str, Any] | None = None) -> int:
        return self.execute(arguments, options).count_rows()


class QueryBuilder:
    """Makes builders that run on an engine."""

    def __init__(self, engine: Any = None):
        self._on = engine

    def select(self, table: Any = None, alias: str | None = None) -> Select:
        return Select(table, alias).bind(self._on)

    def insert(self, table: Any) -> Insert:
        return Insert(table).bind(self._on)

    def update(self, table: Any, alias: str | None = None) -> Update:
        return Update(table, alias).bind(self._on)

    def delete(self, table: Any, alias: str | None = None) -> Delete:
        return Delete(table, alias).bind(self._on)

    def merge(self, table: Any) -> Merge:
        return Merge(table).bind(self._on)

    def insert_values(self, table: Any) -> Insert:
        """An insert that gets its rows from values()."""
        return self.insert(table)

    def insert_query(self, table: Any) -> Insert:
        """An insert that gets its rows from query()."""
        return self.insert(table)

    def upsert_values(self, table: Any) -> Merge:
        """A merge that gets its rows from values()."""
        return self.merge(table)

    def upsert_query(self, table: Any) -> Merge:
        """A merge that gets its rows from query()."""
        return self.merge(table)

    def raw(self, sql: str, arguments: Any = ()) -> RawQuery:
        return RawQuery(sql, arguments).bind(self._on)

    def prepare(self, callback: Any, identifier: str | None = None) -> Prepared:
        return Prepared(self._on, callback, identifier)
