"""Expressions: what may stand in a projection, a predicate, a table list or a value list."""

from __future__ import annotations

import datetime as dt
import inspect
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from quern.errors import QueryError
from quern.functions.types import INTEGERS, spark_type, split_type
from quern.plans.fragments import MARK, Fragment, bind_raw, joined, like_escaped, quoted


class Scope:
    """What a statement is written against: the converter and the tables that are known."""

    def __init__(self, converter: Any, tables: Any = None):
        self.converter, self.tables = converter, tables


class Statement:
    """Anything that can be written."""

    def write(self, scope: Scope) -> Fragment:
        raise NotImplementedError

    def operand(self, scope: Scope) -> Fragment:
        """As part of a larger expression."""
        return self.write(scope)


class Expression(Statement):
    """A statement that gives a value or a table."""

    #: Name that a table expression goes by when none is given.
    default_alias: str | None = None

    def as_table(self, scope: Scope) -> Fragment:
        return "(" + self.write(scope) + ")"


class Raw(Expression):
    """SQL text with placeholders and their arguments."""

    def __init__(self, sql: str, arguments: Any = ()):
        if not isinstance(arguments, (list, tuple)):
            arguments = [arguments]
        self.sql, self.arguments = sql, list(arguments)
        self._written = Fragment(sql) if not self.arguments and "?" not in sql and "$$" not in sql else None

    def write(self, scope: Scope) -> Fragment:
        return self._written or bind_raw(self.sql, self.arguments, scope)

    operand = write


class Identifier(Expression):
    """A name taken whole, dots included."""

    def __init__(self, name: str):
        self.name = name

    def write(self, scope: Scope) -> Fragment:
        return Fragment(quoted(self.name))


class ColumnRef(Expression):
    """[table.]column, * or table.*; a dotted name is split at its first dot."""

    def __init__(self, name: str | Identifier, table: str | None = None):
        if isinstance(name, Identifier):
            name, whole = name.name, True
        else:
            whole = table is not None
        if not name:
            raise QueryError("Expression cannot be null or empty")
        if not whole and "." in name:
            table, name = name.split(".", 1)
        self.name, self.table = name, table
        own = "*" if name == "*" else quoted(name)
        self._written = Fragment(f"{quoted(table)}.{own}" if table else own)

    def write(self, scope: Scope) -> Fragment:
        return self._written

    operand = write


class TableRef(Expression):
    """[schema.]table."""

    def __init__(self, name: str | Identifier, alias: str | None = None, schema: str | None = None):
        if isinstance(name, Identifier):
            name = name.name
        elif schema is None and "." in name:
            schema, name = name.split(".", 1)
        if not name:
            raise QueryError("Expression cannot be null or empty")
        self.name, self.alias, self.schema = name, alias, schema

    @property
    def key(self) -> str:
        return f"{self.schema}.{self.name}" if self.schema else self.name

    @property
    def default_alias(self) -> str:  # type: ignore[override]
        return self.name

    def write(self, scope: Scope) -> Fragment:
        return Fragment(quoted(self.key))

    as_table = write


class Value(Expression):
    """A bound value, converted for its SQL type."""

    def __init__(self, value: Any, sql_type: str | None = None):
        self.value, self.sql_type = value, sql_type

    def write(self, scope: Scope) -> Fragment:
        if self.sql_type is None and type(self.value) in (int, str) and scope.converter.plain(self.value):
            return Fragment(MARK, (self.value,))
        if isinstance(self.value, (list, tuple)) and not (self.sql_type and split_type(self.sql_type)[2]):
            return Row(self.value).write(scope)
        bound = scope.converter.to_sql(self.value, self.sql_type)
        if isinstance(bound, list):
            kind = spark_type(self.sql_type or scope.converter.guess(self.value))
            return "cast(array(" + joined(", ", (Fragment(MARK, (x,)) for x in bound)) + f") as {kind})"
        if isinstance(bound, dt.datetime):  # as text, so that the driver's own zone plays no part
            kind = "timestamp" if bound.tzinfo else "timestamp_ntz"
            return Fragment(f"cast({MARK} as {kind})", (bound.isoformat(" "),))
        mark = Fragment(MARK, (bound,)) if bound is not None else Fragment("NULL")
        return "cast(" + mark + f" as {spark_type(self.sql_type)})" if self.sql_type else mark


class Row(Expression):
    """An ordered tuple of values."""

    def __init__(self, values: Iterable[Any] | Mapping[Any, Any]):
        self.values = [as_value(v) for v in (values.values() if isinstance(values, Mapping) else values)]

    def write(self, scope: Scope) -> Fragment:
        return "struct(" + self.items(scope) + ")"

    def items(self, scope: Scope) -> Fragment:
        return joined(", ", (v.operand(scope) for v in self.values))


class Values(Expression):
    """A constant table; the first row fixes the number of columns."""

    default_alias = None

    def __init__(self, rows: Iterable[Any] = (), columns: Sequence[str] | None = None):
        self.rows: list[Row] = []
        self._names = list(columns) if columns else None
        for row in rows:
            self.row(row)

    def operand(self, scope: Scope) -> Fragment:
        return "(" + self.write(scope) + ")"

    def row(self, values: Any) -> Values:
        row = values if isinstance(values, Row) else Row(values)
        if self.rows and len(row.values) != len(self.rows[0].values):
            raise QueryError(f"A row of {len(row.values)} values in a table of {len(self.rows[0].values)} columns")
        self.rows.append(row)
        return self

    def columns(self, names: Sequence[str]) -> Values:
        self._names = list(names)
        return self

    @property
    def names(self) -> list[str]:
        width = len(self.rows[0].values) if self.rows else 0
        return self._names or [f"col{k + 1}" for k in range(width)]

    def write(self, scope: Scope) -> Fragment:
        if not self.rows:
            raise QueryError("A constant table needs a row")
        if len(self.names) != len(self.rows[0].values):
            raise QueryError("As many column names as values are needed")
        kinds = []
        for column in zip(*(r.values for r in self.rows), strict=True):
            found = {scope.converter.guess(v.value) for v in column if isinstance(v, Value) and v.value is not None and not v.sql_type}
            numbers = found <= {"bigint", "double", "decimal"}
            kinds.append("string" if len(found) > 1 and not numbers else None)  # a column of several kinds is text
        rows = []
        for row in self.rows:
            cells = []
            for v, kind in zip(row.values, kinds, strict=True):
                cell = v.operand(scope)
                cells.append("cast(" + cell + f" as {kind})" if kind else cell)
            rows.append("(" + joined(", ", cells) + ")")
        names = ", ".join(map(quoted, self.names))
        return "select * from values " + joined(", ", rows) + f" as t({names})"


class Cast(Expression):
    """CAST(value AS type). A fraction is rounded on its way to an integer: a double to even, a decimal away from zero.

    The operand is written once, unless it is a column, so that its values keep their places and it is evaluated once.
    """

    def __init__(self, value: Any, to: str, value_type: str | None = None):
        self.value, self.to = as_value(value, value_type), to

    def write(self, scope: Scope) -> Fragment:
        inner, kind = self.value.operand(scope), spark_type(self.to)
        if split_type(self.to)[0] in INTEGERS and not self.to.rstrip().endswith("]"):
            rounded = (
                "case when typeof({0}) in ('double', 'float') then cast(bround(cast({0} as double)) as {1}) "
                "when typeof({0}) like 'decimal%' then cast(round(cast({0} as decimal(38, 10))) as {1}) else cast({0} as {1}) end"
            )
            if isinstance(self.value, ColumnRef):
                return Fragment(rounded.format(inner.text, kind))
            return "transform(array(" + inner + "), quern_x -> " + rounded.format("quern_x", kind) + ")[0]"
        return "cast(" + inner + f" as {kind})"


class Aliased(Expression):
    """Any expression under a name."""

    def __init__(self, expression: Expression, alias: str):
        self.expression, self.alias = expression, alias

    def write(self, scope: Scope) -> Fragment:
        return self.expression.operand(scope) + f" as {quoted(self.alias)}"


class Comparison(Expression):
    """left operator right; a missing side is left out."""

    def __init__(self, left: Expression | None, operator: str, right: Expression | None):
        self.left, self.operator, self.right = left, operator, right

    def write(self, scope: Scope) -> Fragment:
        left, right = self.left and self.left.operand(scope), self.right and self.right.operand(scope)
        if left and right:
            return Fragment(f"{left.text} {self.operator} {right.text}", left.values + right.values)
        return left + f" {self.operator}" if left else f"{self.operator} " + right if right else Fragment(self.operator)


class InList(Expression):
    """[NOT] IN a list or a query. Nothing is in an empty list."""

    def __init__(self, left: Expression, right: Any, negated: bool = False):
        self.left, self.right, self.negated = left, right, negated

    def write(self, scope: Scope) -> Fragment:
        if isinstance(self.right, Statement) and not isinstance(self.right, (Row, Value)):
            inner = self.right.operand(scope)
            inner = inner if inner.text.startswith("(") else "(" + inner + ")"
        else:
            items = self.right.values if isinstance(self.right, Row) else [as_value(v) for v in self.right]
            if not items:
                return Fragment("true" if self.negated else "false")
            inner = "(" + joined(", ", (v.operand(scope) for v in items)) + ")"
        return self.left.operand(scope) + (" not in " if self.negated else " in ") + inner


class Between(Expression):
    """Both bounds belong to it and are not swapped."""

    def __init__(self, value: Expression, low: Any, high: Any, negated: bool = False):
        self.value, self.low, self.high, self.negated = value, as_value(low), as_value(high), negated

    def write(self, scope: Scope) -> Fragment:
        word = " not between " if self.negated else " between "
        return self.value.operand(scope) + word + self.low.operand(scope) + " and " + self.high.operand(scope)


class Like(Expression):
    """LIKE or ILIKE. A value takes the wildcard's place in the pattern, and none of its characters is special."""

    def __init__(self, column: Any, pattern: str, value: str | None = None, wildcard: str = "?", *, negated: bool = False, insensitive: bool = False):
        if value is not None:
            if wildcard not in pattern:
                raise QueryError(f"There is no {wildcard!r} in {pattern!r} for the value")
            pattern = pattern.replace(wildcard, like_escaped(value))
        self.column, self.pattern, self.negated, self.insensitive = as_column(column), pattern, negated, insensitive

    def write(self, scope: Scope) -> Fragment:
        word = ("not " if self.negated else "") + ("ilike" if self.insensitive else "like")
        return self.column.operand(scope) + f" {word} " + Fragment(MARK, (self.pattern,))


class Aggregate(Expression):
    """An aggregate of columns or expressions: of distinct values, of the rows for which a condition holds."""

    def __init__(self, name: str, *arguments: Any, distinct: bool = False, where: Expression | None = None):
        if not re.fullmatch(r"\w+", name):
            raise QueryError(f"{name!r} is no function")
        self.name, self.arguments, self.distinct, self.where = name, [as_column(a) for a in arguments], distinct, where

    def write(self, scope: Scope) -> Fragment:
        inner = joined(", ", (a.operand(scope) for a in self.arguments)) if self.arguments else Fragment("*")
        out = f"{self.name}(" + ("distinct " if self.distinct else "") + inner + ")"
        return out if self.where is None else out + " filter (where " + self.where.write(scope) + ")"


class Window(Expression):
    """A function over the rows of a partition, in an order, in a frame of (unit, start, end).

    Unit is rows or range; bounds are None for unbounded, 0 for the current row, below 0 before and above 0 behind it.
    """

    def __init__(self, function: Any, partition_by: Sequence[Any] = (), order_by: Sequence[Any] = (), frame: tuple[str, int | None, int | None] | None = None):
        self.function = as_raw(function)
        self.partition = [as_column(p) for p in partition_by]
        self.order = [o if isinstance(o, tuple) else (o, "asc") for o in order_by]
        self.frame = frame

    @staticmethod
    def _bound(at: int | None, unbounded: str) -> str:
        return f"unbounded {unbounded}" if at is None else "current row" if at == 0 else f"{abs(at)} {'preceding' if at < 0 else 'following'}"

    def write(self, scope: Scope) -> Fragment:
        parts = []
        if self.partition:
            parts.append("partition by " + joined(", ", (p.operand(scope) for p in self.partition)))
        if self.order:
            items = []
            for column, way in self.order:
                way = str(getattr(way, "value", way)).lower()
                if way not in ("asc", "desc"):
                    raise QueryError(f"{way!r} is no order")
                items.append(as_column(column).operand(scope) + f" {way} nulls {'last' if way == 'asc' else 'first'}")
            parts.append("order by " + joined(", ", items))
        if self.frame:
            unit, start, end = self.frame
            if unit not in ("rows", "range"):
                raise QueryError(f"{unit!r} is no frame")
            parts.append(Fragment(f"{unit} between {self._bound(start, 'preceding')} and {self._bound(end, 'following')}"))
        return self.function.operand(scope) + " over (" + joined(" ", parts) + ")"


class Groups(Expression):
    """ROLLUP, CUBE or GROUPING SETS of columns."""

    def __init__(self, word: str, items: Sequence[Any]):
        self.word = word
        self.items = [[as_column(c) for c in x] if isinstance(x, (list, tuple)) else [as_column(x)] for x in items]

    def write(self, scope: Scope) -> Fragment:
        sets = ("(" + joined(", ", (c.operand(scope) for c in item)) + ")" if item else Fragment("()") for item in self.items)
        return f"{self.word} (" + joined(", ", sets) + ")"


class Exists(Expression):
    def __init__(self, query: Statement, negated: bool = False):
        self.query, self.negated = query, negated

    def write(self, scope: Scope) -> Fragment:
        return ("not " if self.negated else "") + "exists (" + self.query.write(scope) + ")"


def called(candidate: Any, *context: Any) -> Any:
    """The result of a callable, else the candidate; strings are never called. None means that it took care itself."""
    if callable(candidate) and not isinstance(candidate, (Statement, str, type)):
        try:
            takes = [p for p in inspect.signature(candidate).parameters.values() if p.default is p.empty and p.kind is not p.VAR_KEYWORD]
        except (TypeError, ValueError):
            takes = list(context)
        return candidate(*context) if takes else candidate()
    return candidate


def as_column(candidate: Any, *context: Any) -> Expression:
    """A column name, expression, or callable that gives one."""
    candidate = called(candidate, *context)
    if candidate is None or (isinstance(candidate, str) and not candidate):
        raise QueryError("Expression cannot be null or empty")
    return ColumnRef(candidate) if isinstance(candidate, str) else candidate


def as_value(candidate: Any, sql_type: str | None = None, *context: Any) -> Expression:
    candidate = called(candidate, *context)
    return candidate if isinstance(candidate, Statement) else Value(candidate, sql_type)  # type: ignore[return-value]


def as_raw(candidate: Any, arguments: Any = (), *context: Any) -> Expression:
    """SQL text, expression, or callable that gives one."""
    candidate = called(candidate, *context)
    if candidate is None or (isinstance(candidate, str) and not candidate):
        raise QueryError("Expression cannot be null or empty")
    if isinstance(candidate, str):
        return Raw(candidate, arguments)
    if arguments not in ((), [], None):
        raise QueryError("Arguments go with SQL text only")
    return candidate


Callback = Callable[..., Any]
