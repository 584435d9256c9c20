"""SQL type names, their Spark types, and value conversion in both directions."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import uuid
from collections.abc import Callable
from decimal import Decimal, InvalidOperation
from functools import lru_cache
from typing import Any
from zoneinfo import ZoneInfo

from quern.errors import TypeConversionError
from quern.functions.texts import format_array, format_interval, format_row, parse_array, parse_interval, parse_row

#: SQL type names by canonical type, and the Spark type of each canonical type.
ALIASES = {
    "smallint": ("smallint", "int2", "smallserial", "serial2"),
    "integer": ("integer", "int", "int4", "serial", "serial4"),
    "bigint": ("bigint", "int8", "long", "bigserial", "serial8"),
    "decimal": ("decimal", "numeric"),
    "real": ("real", "float4", "float"),
    "double": ("double", "double precision", "float8"),
    "boolean": ("boolean", "bool"),
    "varchar": ("varchar", "string", "text", "char", "character", "character varying"),
    "bytea": ("bytea", "blob", "binary"),
    "date": ("date",),
    "timestamp": ("timestamp", "datetime", "timestamp without time zone", "timestamp_ntz"),
    "timestamptz": ("timestamptz", "timestampz", "timestamp with time zone", "timestamp_ltz"),
    "time": ("time", "time without time zone"),
    "timetz": ("timetz", "timez", "time with time zone"),
    "interval": ("interval",),
    "json": ("json", "jsonb"),
    "uuid": ("uuid",),
    "row": ("row", "record"),
    "null": ("null", "void"),
}
SPARK = {
    "smallint": "smallint", "integer": "int", "bigint": "bigint", "decimal": "decimal(38,10)", "real": "float", "double": "double",
    "boolean": "boolean", "varchar": "string", "bytea": "binary", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp",
    "time": "string", "timetz": "string", "interval": "string", "json": "string", "uuid": "string", "row": "string", "null": "void",
}
INTEGERS = {"smallint": 16, "integer": 32, "bigint": 64}
_CANONICAL = {alias: name for name, aliases in ALIASES.items() for alias in aliases}


@lru_cache(maxsize=1024)
def split_type(name: str) -> tuple[str, str, int]:
    """Canonical element type, parameters in brackets, and array depth of a type name."""
    text, depth = re.sub(r"\s+", " ", name.strip().lower()), 0
    while text.endswith("[]") or text.startswith("_"):
        text, depth = (text[:-2].strip() if text.endswith("[]") else text[1:]), depth + 1
    found = re.fullmatch(r"([a-z0-9_ ]+?)\s*(\([\d, ]+\))?( with(?:out)? time zone)?", text)
    if not found:
        return text, "", depth
    base = found[1] + (found[3] or "")
    return _CANONICAL.get(base, base), found[2] or "", depth


def canonical(name: str) -> str:
    base, _, depth = split_type(name)
    return base + "[]" * depth


@lru_cache(maxsize=1024)
def spark_type(name: str) -> str:
    """The Spark type for a SQL type name; other names are taken to be Spark's own."""
    base, brackets, depth = split_type(name)
    if base not in SPARK:
        return name
    inner = f"decimal{brackets}" if base == "decimal" and brackets else SPARK[base]
    for _ in range(depth):
        inner = f"array<{inner}>"
    return inner


class Converter:
    """Values between SQL types and Python types.

    Converters of the user's own come first: register(sql_type, python_type, to_sql, from_sql).
    """

    def __init__(self, timezone: str = "UTC"):
        self.zone = ZoneInfo(timezone)
        self._own: dict[tuple[str, type], tuple[Callable, Callable]] = {}
        self._writers: dict[str, Callable[[Any], Any]] = {}
        self._readers: dict[str, Callable[[Any], Any]] = {}

    def register(self, sql_type: str, python_type: type, to_sql: Callable[[Any], Any], from_sql: Callable[[Any], Any]) -> None:
        self._own[canonical(sql_type), python_type] = (to_sql, from_sql)
        self._writers.clear()
        self._readers.clear()

    def plain(self, value: int | str) -> bool:
        """Whether a value is bound as it is."""
        return not self._own and (type(value) is str or -(1 << 63) <= value < 1 << 63)

    def guess(self, value: Any) -> str:
        """The SQL type of a Python value."""
        for kinds, name in _GUESSES:
            if isinstance(value, kinds):
                if name == "timestamp":
                    return "timestamptz" if value.tzinfo else name
                return name
        if isinstance(value, (list, tuple)):
            inner = next((self.guess(v) for v in value if v is not None), "varchar")
            return f"{inner}[]"
        return "varchar"

    def to_sql(self, value: Any, sql_type: str | None = None) -> Any:
        """A value that Spark can bind for the SQL type."""
        if value is None:
            return None
        if sql_type is not None:
            return (self._writers.get(sql_type) or self.writer(sql_type))(value)
        return self._to_sql(value, None)

    def writer(self, sql_type: str) -> Callable[[Any], Any]:
        """to_sql for values of one type that are not null, made once."""
        base, _, depth = split_type(sql_type)
        whole = lambda value: self._to_sql(value, sql_type)
        found = whole
        if not self._own and depth == 0:
            if base in INTEGERS:
                top = 1 << (INTEGERS[base] - 1)
                found = lambda value: value if type(value) is int and -top <= value < top else whole(value)
            elif base == "uuid":
                found = lambda value: _uuid_text(value.int) if type(value) is uuid.UUID else whole(value)
            elif base == "varchar":
                found = lambda value: value if type(value) is str else whole(value)
        elif not self._own and depth == 1:
            one = self.writer(base)
            found = lambda value: [None if v is None else one(v) for v in value] if type(value) is list else whole(value)
        self._writers[sql_type] = found
        return found

    def _to_sql(self, value: Any, sql_type: str | None) -> Any:
        if value is None or sql_type == "null":
            return None
        base, _, depth = split_type(sql_type or self.guess(value))
        if depth:
            if isinstance(value, str):
                value = parse_array(value)
            if not isinstance(value, (list, tuple)):
                raise TypeConversionError(f"{value!r} is not an array")
            inner = base + "[]" * (depth - 1)
            return [self.to_sql(v, inner) for v in value]
        if self._own:
            for kind in type(value).__mro__:
                if (base, kind) in self._own:
                    return self._own[base, kind][0](value)
        return self._convert(value, base, "in")

    def from_sql(self, value: Any, sql_type: str | None = None, python_type: type | None = None) -> Any:
        """A Python value of the SQL type, of python_type if that is asked for."""
        if value is None:
            return None
        if python_type is None and sql_type is not None:
            return (self._readers.get(sql_type) or self.reader(sql_type))(value)
        return self._from_sql(value, sql_type, python_type)

    def reader(self, sql_type: str) -> Callable[[Any], Any]:
        """from_sql for values of one type that are not null, made once."""
        base, _, depth = split_type(sql_type)
        whole = lambda value: self._from_sql(value, sql_type)
        found = whole
        if not self._own and depth == 0:
            if base in INTEGERS:
                top = 1 << (INTEGERS[base] - 1)

                def found(value: Any) -> int:
                    if type(value) is str and value.isdecimal():
                        value = int(value)
                    return value if type(value) is int and -top <= value < top else whole(value)

            elif base == "uuid":
                found = lambda value: _uuid_of(value) if type(value) is str and len(value) == 36 else whole(value)
            elif base == "varchar":
                found = lambda value: value if type(value) is str else whole(value)
        elif not self._own and depth == 1:
            one = self.reader(base)

            def found(value: Any) -> list:
                items = parse_array(value) if type(value) is str else value
                return [None if v is None else one(v) if type(v) is not list else whole(v) for v in items]

        self._readers[sql_type] = found
        return found

    def _from_sql(self, value: Any, sql_type: str | None = None, python_type: type | None = None) -> Any:
        if value is None or sql_type == "null":
            return None
        if sql_type is None and python_type is None and isinstance(value, (int, float)):
            return value
        base, _, depth = split_type(sql_type or "varchar")
        if depth:
            items = parse_array(value) if isinstance(value, str) else list(value)
            return [self.from_sql(v, base + "[]" * (depth - 1), python_type) for v in items]
        for (name, kind), (_, read) in self._own.items():
            if name == base and python_type in (None, kind):
                return read(value)
        found = self._convert(value, base, "out")
        return found if python_type is None or type(found) is python_type else self._as(found, python_type)

    def _as(self, value: Any, kind: type) -> Any:
        if isinstance(value, kind) and not (kind is int and isinstance(value, bool)):
            return value
        if kind is str and isinstance(value, (int, float, Decimal, uuid.UUID)):
            return str(value)
        if kind is bytes and isinstance(value, str):
            return value.encode()
        if kind in (int, float) and isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
            return kind(value)
        if kind is Decimal and isinstance(value, (int, float)):
            return Decimal(str(value))
        raise TypeConversionError(f"{value!r} can't become a {kind.__name__}")

    def _convert(self, value: Any, base: str, way: str) -> Any:
        try:
            return _CONVERSIONS[base](self, value, way) if base in _CONVERSIONS else value
        except TypeConversionError:
            raise
        except (ValueError, TypeError, ArithmeticError, InvalidOperation) as e:
            raise TypeConversionError(f"{value!r} is no {base}") from e

    def _integer(self, value: Any, way: str, bits: int) -> int:
        if isinstance(value, str):
            try:
                value = int(value)
            except ValueError:
                value = Decimal(value.strip())
        if isinstance(value, (float, Decimal)):
            if not math.isfinite(value):
                raise TypeConversionError(f"{value!r} is no integer")
            value = round(value)
        value = int(value)
        if not -(1 << (bits - 1)) <= value < 1 << (bits - 1):
            raise TypeConversionError(f"{value} has more than {bits} bits")
        return value

    def _boolean(self, value: Any, way: str) -> bool:
        if isinstance(value, str):
            text = value.strip().lower()
            if text in ("t", "true", "1", "y", "yes", "on"):
                return True
            if text in ("f", "false", "0", "n", "no", "off", ""):
                return False
            raise TypeConversionError(f"{value!r} is no boolean")
        return bool(value)

    def _text(self, value: Any, way: str) -> str:
        return value.decode() if isinstance(value, (bytes, bytearray)) else str(value)

    def _bytes(self, value: Any, way: str) -> bytes:
        return bytes(value) if isinstance(value, (bytes, bytearray, memoryview)) else str(value).encode()

    def _date(self, value: Any, way: str) -> dt.date:
        if isinstance(value, str):
            value = dt.datetime.fromisoformat(value.strip())
        if isinstance(value, dt.datetime):
            return (value.astimezone(self.zone) if value.tzinfo else value).date()
        if isinstance(value, dt.date):
            return value
        raise TypeConversionError(f"{value!r} is no date")

    def _timestamp(self, value: Any, way: str, zoned: bool = False) -> dt.datetime:
        if isinstance(value, str):
            value = dt.datetime.fromisoformat(value.strip())
        if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
            value = dt.datetime.combine(value, dt.time())
        if not isinstance(value, dt.datetime):
            raise TypeConversionError(f"{value!r} is no timestamp")
        if way == "in":
            if zoned:
                return value if value.tzinfo else value.replace(tzinfo=self.zone)
            return value.astimezone(self.zone).replace(tzinfo=None) if value.tzinfo else value
        return value.astimezone(self.zone) if value.tzinfo else value.replace(tzinfo=self.zone)

    def _time(self, value: Any, way: str, zoned: bool = False) -> Any:
        if isinstance(value, str):
            value = dt.time.fromisoformat(value.strip())
        if isinstance(value, dt.datetime):
            value = (value.astimezone(self.zone) if value.tzinfo else value).timetz()
        if not isinstance(value, dt.time):
            raise TypeConversionError(f"{value!r} is no time")
        if way == "in":
            return (value if zoned else value.replace(tzinfo=None)).isoformat("microseconds")
        return value

    def _interval(self, value: Any, way: str) -> Any:
        return format_interval(value) if way == "in" else parse_interval(value)

    def _json(self, value: Any, way: str) -> Any:
        if way == "in":
            return value if isinstance(value, str) else json.dumps(value)
        return json.loads(value) if isinstance(value, (str, bytes)) else value

    def _uuid(self, value: Any, way: str) -> Any:
        found = value if isinstance(value, uuid.UUID) else uuid.UUID(str(value))
        return str(found) if way == "in" else found

    def _row(self, value: Any, way: str) -> Any:
        if way == "in":
            return value if isinstance(value, str) else format_row(value)
        return parse_row(value) if isinstance(value, str) else list(value)


def _uuid_text(number: int) -> str:
    h = f"{number:032x}"
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def _uuid_of(text: str) -> uuid.UUID:
    """A uuid of 36 characters; others go the long way, which knows more forms and says what is wrong."""
    digits = text.replace("-", "")
    if len(digits) == 32 and digits.isalnum():
        try:
            number = int(digits, 16)
        except ValueError:
            pass
        else:
            out = object.__new__(uuid.UUID)
            object.__setattr__(out, "int", number)
            object.__setattr__(out, "is_safe", uuid.SafeUUID.unknown)
            return out
    try:
        return uuid.UUID(text)
    except ValueError as e:
        raise TypeConversionError(f"{text!r} is no uuid") from e


_CONVERSIONS: dict[str, Callable[[Converter, Any, str], Any]] = {
    **{name: (lambda c, v, w, bits=bits: c._integer(v, w, bits)) for name, bits in INTEGERS.items()},
    "decimal": lambda c, v, w: v if isinstance(v, Decimal) else Decimal(str(v).strip()),
    "real": lambda c, v, w: float(v),
    "double": lambda c, v, w: float(v),
    "boolean": Converter._boolean,
    "varchar": Converter._text,
    "bytea": Converter._bytes,
    "date": Converter._date,
    "timestamp": Converter._timestamp,
    "timestamptz": lambda c, v, w: c._timestamp(v, w, True),
    "time": Converter._time,
    "timetz": lambda c, v, w: c._time(v, w, True),
    "interval": Converter._interval,
    "json": Converter._json,
    "uuid": Converter._uuid,
    "row": Converter._row,
}
_GUESSES: list[tuple[Any, str]] = [
    (bool, "boolean"), (int, "bigint"), (float, "double"), (Decimal, "decimal"), (str, "varchar"), ((bytes, bytearray), "bytea"),
    (dt.datetime, "timestamp"), (dt.date, "date"), (dt.time, "time"), (dt.timedelta, "interval"), (uuid.UUID, "uuid"), (dict, "json"),
]


def array_text(value: list) -> str:
    """An array as text, elements quoted where they need it."""
    return format_array(value)
