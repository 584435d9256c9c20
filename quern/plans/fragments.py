"""Pieces of Spark SQL with the values bound to them, and the placeholder grammar of raw text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import TYPE_CHECKING, Any

from quern.errors import QueryError

if TYPE_CHECKING:
    from quern.plans.expressions import Expression


@lru_cache(maxsize=8192)
def quoted(name: str) -> str:
    """An identifier that Spark takes literally."""
    return "`" + name.replace("`", "``") + "`"


def like_escaped(value: str) -> str:
    """A value in which no character is a wildcard."""
    return re.sub(r"([\\%_])", r"\\\1", value)


#: Stands for a value until the whole statement is known.
MARK = "\x00"


class Fragment:
    """Text with a mark for each of values, in order. Never changed once made."""

    __slots__ = ("text", "values")

    def __init__(self, text: str, values: tuple[Any, ...] = ()):
        self.text, self.values = text, values

    def __add__(self, other: Fragment | str) -> Fragment:
        if isinstance(other, str):
            return Fragment(self.text + other, self.values)
        return Fragment(self.text + other.text, self.values + other.values)

    def __radd__(self, other: str) -> Fragment:
        return Fragment(other + self.text, self.values)

    def __repr__(self) -> str:
        return f"Fragment({self.text!r}, {self.values!r})"


EMPTY = Fragment("")


def named(fragment: Fragment, values: Sequence[Any] | None = None) -> tuple[str, dict[str, Any]]:
    """The text with named parameters in place of marks, and their values."""
    first, *rest = fragment.text.split(MARK)
    text = first + "".join(f":quern_{k} {part}" for k, part in enumerate(rest))
    return text, {f"quern_{k}": v for k, v in enumerate(fragment.values if values is None else values)}


def joined(glue: str, parts: Iterable[Fragment]) -> Fragment:
    items = list(parts)
    if len(items) == 1:
        return items[0]
    values: tuple[Any, ...] = ()
    for p in items:
        if p.values:
            values += p.values
    return Fragment(glue.join([p.text for p in items]), values)


def glued(parts: Sequence[Fragment | str]) -> Fragment:
    """Pieces of text and fragments, one after the other."""
    values: tuple[Any, ...] = ()
    for p in parts:
        if p.__class__ is not str and p.values:
            values += p.values
    return Fragment("".join([p if p.__class__ is str else p.text for p in parts]), values)


#: Quoted stretches are passed over; then ?? (a literal question mark) and ? with an optional ::type behind it.
_TOKENS = re.compile(
    r"""'(?:[^'\\]|''|\\.)*' | "(?:[^"\\]|""|\\.)*" | `(?:[^`]|``)*` | \$\$.*?\$\$ | \?\? | \?(?:::(?P<type>[a-z_][\w]*(?:\ (?:precision|with(?:out)?\ time\ zone))?(?:\[\])*))?""",
    re.S | re.X | re.I,
)


@dataclass(frozen=True)
class RawPart:
    """One piece of raw text: text to keep, or a placeholder with its type hint."""

    text: str = ""
    placeholder: bool = False
    hint: str | None = None


@lru_cache(maxsize=4096)
def split_raw(sql: str) -> list[RawPart]:
    if "?" not in sql and "$$" not in sql:
        return [RawPart(sql)] if sql else []
    out, at = [], 0
    for found in _TOKENS.finditer(sql):
        out.append(RawPart(sql[at : found.start()]))
        token, at = found[0], found.end()
        if token == "??":
            out.append(RawPart("?"))
        elif token.startswith("?"):
            out.append(RawPart(placeholder=True, hint=found["type"]))
        elif token.startswith("$$"):
            out.append(RawPart("'" + token[2:-2].replace("\\", "\\\\").replace("'", "\\'") + "'"))
        else:
            out.append(RawPart(token))
    out.append(RawPart(sql[at:]))
    return [p for p in out if p.text or p.placeholder]


def bind_raw(sql: str, arguments: Sequence[Any], scope: Any) -> Fragment:
    """Raw text with its placeholders filled from arguments; statements are written in place."""
    from quern.plans.expressions import Statement, Value

    out, left = [], list(arguments)
    for part in split_raw(sql):
        if not part.placeholder:
            out.append(part.text)
            continue
        if not left:
            raise QueryError(f"Too few arguments for {sql!r}")
        value = left.pop(0)
        node: Expression = value if isinstance(value, Statement) else Value(value, part.hint)
        out.append(node.operand(scope))
    if left:
        raise QueryError(f"Too many arguments for {sql!r}")
    return glued(out)
