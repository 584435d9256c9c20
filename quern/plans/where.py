"""The predicate tree of WHERE, HAVING and ON."""

from __future__ import annotations

import re
from typing import Any

from quern.errors import QueryError
from quern.plans.expressions import (
    Between, Comparison, Exists, Expression, InList, Like, Raw, Row, Scope, Statement, Value, as_column, as_raw, as_value, called,
)
from quern.plans.fragments import Fragment, joined

#: Operators under the names that Spark has for them. Any other is written as it is, for Spark to accept or refuse.
OPERATORS = {
    "=": "=", "==": "=", "<>": "<>", "!=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "<=>": "<=>",
    "is distinct from": "is distinct from", "is not distinct from": "is not distinct from", "is not": "is distinct from", "is": "is not distinct from",
    "like": "like", "not like": "not like", "ilike": "ilike", "not ilike": "not ilike", "rlike": "rlike", "regexp": "regexp", "~": "rlike",
    "in": "in", "not in": "not in", "between": "between", "not between": "not between", "is null": "is null", "is not null": "is not null",
}


#: Operators that Spark has as functions: {0} is the left side, {1} the right one.
FUNCTIONS = {
    "!~": "not rlike({0}, {1})", "~*": "rlike({0}, concat('(?i)', {1}))", "!~*": "not rlike({0}, concat('(?i)', {1}))",
    "similar to": "rlike({0}, concat('^(?:', replace(replace({1}, '%', '.*'), '_', '.'), ')$'))",
    "not similar to": "not rlike({0}, concat('^(?:', replace(replace({1}, '%', '.*'), '_', '.'), ')$'))",
    "@>": "size(array_except({1}, {0})) = 0", "<@": "size(array_except({0}, {1})) = 0", "&&": "arrays_overlap({0}, {1})",
    "^@": "startswith({0}, {1})",
}


def value_kind(values: Any) -> str:
    """The SQL type of the elements of an array that is given as a list."""
    kinds = {type(v) for v in values if v is not None}
    return "bigint" if kinds == {int} else "double" if kinds and kinds <= {int, float} else "varchar"


class Called(Expression):
    """An operator that is a function in Spark."""

    def __init__(self, form: str, left: Expression, right: Expression):
        self.form, self.left, self.right = form, left, right

    def write(self, scope: Scope) -> Fragment:
        out, sides = Fragment(""), (self.left.operand(scope), self.right.operand(scope))
        for part in re.split(r"(\{[01]\})", self.form):
            out = out + (sides[int(part[1])] if part in ("{0}", "{1}") else part)
        return out


class Where(Expression):
    """Conditions that hold together (AND) or one by one (OR); may nest."""

    def __init__(self, operator: str = "and", parent: Where | None = None):
        self.operator, self.parent = operator, parent
        self.conditions: list[Statement] = []

    def __bool__(self) -> bool:
        return any(bool(c) if isinstance(c, Where) else True for c in self.conditions)

    def copy(self) -> Where:
        out = Where(self.operator)
        for c in self.conditions:
            inner = c.copy() if isinstance(c, Where) else c
            if isinstance(inner, Where):
                inner.parent = out
            out.conditions.append(inner)
        return out

    def write(self, scope: Scope) -> Fragment:
        parts = [c for c in self.conditions if not isinstance(c, Where) or c]
        if not parts:
            return Fragment("true")
        if len(parts) == 1:
            return parts[0].operand(scope)
        inner = joined(f") {self.operator} (", [p.write(scope) for p in parts])
        return Fragment(f"({inner.text})", inner.values)

    def operand(self, scope: Scope) -> Fragment:
        return "(" + self.write(scope) + ")"

    def _add(self, condition: Statement) -> Where:
        self.conditions.append(condition)
        return self

    def condition(self, column: Any, value: Any = None, operator: str = "=") -> Where:
        """A comparison; lists and queries turn = and <> into IN and NOT IN."""
        op = " ".join(operator.lower().split())
        if not op:
            raise QueryError("A condition needs an operator")
        op = OPERATORS.get(op, op)
        if (left := called(column, self)) is None and callable(column):
            return self  # the callable has added its own conditions
        if isinstance(left, Where):
            return self if left is self else self._add(left)
        left = as_column(left)
        if op in ("is null", "is not null"):
            if value is not None:
                raise QueryError(f"{op} takes no value")
            return self._add(Comparison(left, op, None))
        value = called(value, self)
        if op in ("between", "not between"):
            if not isinstance(value, (list, tuple)) or len(value) != 2:
                raise QueryError(f"{op} takes two values")
            return self._add(Between(left, *value, negated=op == "not between"))
        if op in FUNCTIONS:
            right = as_value(Value(value, f"{value_kind(value)}[]") if isinstance(value, (list, tuple)) else value)
            return self._add(Called(FUNCTIONS[op], left, right))
        many = isinstance(value, (list, tuple, set, frozenset)) or getattr(value, "returns_rows", False)
        if op in ("in", "not in") or (many and op in ("=", "<>")):
            items = value if many or isinstance(value, (Row, Raw)) else [value]
            return self._add(InList(left, items, op in ("<>", "not in")))
        return self._add(Comparison(left, op, as_value(value)))

    def expression(self, expression: Any, arguments: Any = ()) -> Where:
        found = called(expression, self)
        if found is None and callable(expression):
            return self
        if found is self:
            return self
        return self._add(as_raw(found, arguments))

    def exists(self, query: Statement) -> Where:
        return self._add(Exists(called(query, self)))

    def not_exists(self, query: Statement) -> Where:
        return self._add(Exists(called(query, self), negated=True))

    def open(self, operator: str = "and") -> Where:
        """A nested group, which close() leaves."""
        inner = Where(operator, self)
        self.conditions.append(inner)
        return inner

    def close(self) -> Where:
        if self.parent is None:
            raise QueryError("There is no group to close")
        return self.parent

    end = close

    def _group(self, operator: str, callback: Any) -> Where:
        inner = self.open(operator)
        if callback is None:
            return inner
        found = callback(inner)
        if isinstance(found, Statement) and found is not inner:
            inner._add(found)
        return self

    def and_(self, callback: Any = None) -> Where:
        return self._group("and", callback)

    def or_(self, callback: Any = None) -> Where:
        return self._group("or", callback)

    def is_equal(self, column: Any, value: Any) -> Where:
        return self.condition(column, value, "=")

    def is_not_equal(self, column: Any, value: Any) -> Where:
        return self.condition(column, value, "<>")

    def is_in(self, column: Any, values: Any) -> Where:
        return self.condition(column, values, "in")

    def is_not_in(self, column: Any, values: Any) -> Where:
        return self.condition(column, values, "not in")

    def is_greater(self, column: Any, value: Any) -> Where:
        return self.condition(column, value, ">")

    def is_greater_or_equal(self, column: Any, value: Any) -> Where:
        return self.condition(column, value, ">=")

    def is_less(self, column: Any, value: Any) -> Where:
        return self.condition(column, value, "<")

    def is_less_or_equal(self, column: Any, value: Any) -> Where:
        return self.condition(column, value, "<=")

    def is_between(self, column: Any, low: Any, high: Any) -> Where:
        return self.condition(column, [low, high], "between")

    def is_not_between(self, column: Any, low: Any, high: Any) -> Where:
        return self.condition(column, [low, high], "not between")

    def is_null(self, column: Any) -> Where:
        return self.condition(column, None, "is null")

    def is_not_null(self, column: Any) -> Where:
        return self.condition(column, None, "is not null")

    def is_like(self, column: Any, pattern: str, value: str | None = None, wildcard: str = "?") -> Where:
        return self._add(Like(column, pattern, value, wildcard))

    def is_not_like(self, column: Any, pattern: str, value: str | None = None, wildcard: str = "?") -> Where:
        return self._add(Like(column, pattern, value, wildcard, negated=True))

    def is_like_insensitive(self, column: Any, pattern: str, value: str | None = None, wildcard: str = "?") -> Where:
        return self._add(Like(column, pattern, value, wildcard, insensitive=True))

    def is_not_like_insensitive(self, column: Any, pattern: str, value: str | None = None, wildcard: str = "?") -> Where:
        return self._add(Like(column, pattern, value, wildcard, negated=True, insensitive=True))
