"""Reading results: one pass or rewindable, typed rows, hydration, pages."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame

from quern.errors import InvalidDataAccess, LockedResult, QueryError
from quern.functions.types import Converter
from quern.sources.store import _sql_type


class Row(Mapping[str, Any]):
    """One row: raw values, converted when they are asked for. It can't be changed."""

    __slots__ = ("_converter", "_names", "_types", "_values")

    def __init__(self, names: list[str], types: list[str], values: tuple, converter: Converter):
        self._names, self._types, self._values, self._converter = names, types, values, converter

    def _at(self, key: str | int) -> int:
        if isinstance(key, int):
            if -len(self._values) <= key < len(self._values):
                return key
        else:
            for k in range(len(self._names) - 1, -1, -1):  # of equal names the last counts
                if self._names[k] == key:
                    return k
        raise InvalidDataAccess(f"There is no column {key!r}")

    def get(self, key: str | int, kind: type | None = None) -> Any:  # type: ignore[override]
        k = self._at(key)
        return self._converter.from_sql(self._values[k], self._types[k], kind)

    def __getitem__(self, key: str | int) -> Any:
        return self.get(key)

    def raw(self, key: str | int) -> Any:
        return self._values[self._at(key)]

    def has(self, key: str | int) -> bool:
        try:
            self._at(key)
        except InvalidDataAccess:
            return False
        return True

    def __iter__(self) -> Iterator[str]:
        return iter(dict.fromkeys(self._names))

    def __len__(self) -> int:
        return len(self._names)

    def to_dict(self) -> dict[str, Any]:
        return {n: self.get(n) for n in self}

    def to_raw_dict(self) -> dict[str, Any]:
        return dict(zip(self._names, self._values, strict=True))


def hydrated(kind: type, row: Row) -> Any:
    """An object of a class, made without its constructor, with the row's columns as attributes."""
    out = kind.__new__(kind)
    for name in row:
        object.__setattr__(out, name, row.get(name))
    return out


def expanded(values: Mapping[str, Any], separator: str = ".", drop_null_groups: bool = True) -> dict[str, Any]:
    """Keys with separators as nested dictionaries; a group of nulls only becomes a null or is kept as it is."""
    out: dict[str, Any] = {}
    for key, value in values.items():
        *path, last = key.split(separator)
        at = out
        for name in path:
            nested = at.get(name)
            if not isinstance(nested, dict):
                nested = at[name] = {}
            at = nested
        at[last] = value
    if drop_null_groups:
        _drop_nulls(out)
    return out


def _drop_nulls(values: dict[str, Any]) -> None:
    for key in [k for k, v in values.items() if isinstance(v, dict)]:
        _drop_nulls(values[key])
        if all(v is None for v in values[key].values()):
            values[key] = None


class Result:
    """Rows of a DataFrame. Without rewindable() they can be read once, partition by partition."""

    def __init__(self, frame: DataFrame | None, converter: Converter, affected: int | None = None, types: Mapping[str, str] | None = None):
        self.frame, self._converter, self._affected = frame, converter, affected
        fields = frame.schema.fields if frame is not None else []
        self._names = [f.name for f in fields]
        self._types = [(types or {}).get(f.name) or _sql_type(f.dataType) for f in fields]
        self._kept: list[Any] | None = None
        self._started = False
        self._pull: Iterator[Any] | None = None
        self._hydrator: Callable[[Row], Any] | None = None
        self._key: str | None = None
        self._count: int | None = None
        #: Times of the query, set by the engine.
        self.profile: Any = None

    # setting up
    def _unlocked(self) -> None:
        if self._started:
            raise LockedResult("The result is already being read")

    def rewindable(self, rewindable: bool = True) -> Result:
        self._unlocked()
        self._kept = [] if rewindable else None
        return self

    def hydrate(self, hydrator: Callable[[Row], Any] | type | None) -> Result:
        """Rows become what a callable makes of them, or objects of a class."""
        self._unlocked()
        self._hydrator = (lambda row, kind=hydrator: hydrated(kind, row)) if isinstance(hydrator, type) else hydrator
        return self

    def key_column(self, name: str | None) -> Result:
        self._unlocked()
        if name is not None and name not in self._names:
            raise InvalidDataAccess(f"There is no column {name!r}")
        self._key = name
        return self

    # reading
    def _rows(self) -> Iterator[Row]:
        if self._pull is None:
            self._pull = iter(self.frame.toLocalIterator()) if self.frame is not None else iter(())
        self._started = True
        for values in self._pull:
            yield Row(self._names, self._types, tuple(values), self._converter)

    def _items(self) -> Iterator[tuple[Row, Any]]:
        for row in self._rows():
            item = (row, self._hydrator(row) if self._hydrator else row)
            if self._kept is not None:
                self._kept.append(item)
            yield item

    def __iter__(self) -> Iterator[Any]:
        for item in list(self._kept or ()):
            yield item[1]
        for _, item in self._items():
            yield item

    def items(self) -> Iterator[tuple[Any, Any]]:
        """Pairs of key and row; the key is the key column's value, or the place."""
        held = list(self._kept or ())
        for n, (row, item) in enumerate([*held]):
            yield (row.get(self._key) if self._key else n), item
        for n, (row, item) in enumerate(self._items(), len(held)):
            yield (row.get(self._key) if self._key else n), item

    def fetch(self) -> Any:
        """The next row, or None."""
        return next((item for _, item in self._items()), None)

    def fetch_field(self, name: str | int | None = None) -> Any:
        """A value of the next row: its first, or the named one."""
        row = next((row for row, _ in self._items()), None)
        return None if row is None else row.get(0 if name is None else name)

    def fetch_column(self, name: str | int = 0) -> Any:
        """All values of a column: a list, or a dictionary where there is a key column."""
        rows = [r for r, _ in (self._kept or ())] + [r for r, _ in self._items()]
        if self._key:
            return {r.get(self._key): r.get(name) for r in rows}
        return [r.get(name) for r in rows]

    def fetch_all(self) -> list[Any]:
        return list(self)

    # describing
    def count_rows(self) -> int:
        """Rows of the result; of a change without returned rows, those that it touched."""
        if self.frame is None:
            return self._affected or 0
        if self._count is None:
            self._count = self.frame.count()
        return self._count

    def count(self) -> int:
        return 0 if self.frame is None else self.count_rows()

    def count_columns(self) -> int:
        return len(self._names)

    def column_exists(self, name: str) -> bool:
        return name in self._names

    def column_names(self) -> list[str]:
        return list(self._names)

    def column_types(self) -> dict[str, str]:
        return dict(zip(self._names, self._types, strict=True))

    def column_type(self, name: str) -> str:
        return self._types[self.column_number(name)]

    def column_number(self, name: str) -> int:
        if name not in self._names:
            raise InvalidDataAccess(f"There is no column {name!r}")
        return self._names.index(name)

    def column_name(self, number: int) -> str:
        if not 0 <= number < len(self._names):
            raise InvalidDataAccess(f"There is no column {number}")
        return self._names[number]


class Page:
    """A page of a result, and where it stands among all rows."""

    def __init__(self, items: Any, total: int, limit: int, page: int = 1):
        if page < 1 or limit < 0:
            raise QueryError("Pages are counted from 1")
        self._items, self._total, self.limit, self.page = items, total, limit, page

    def __iter__(self) -> Iterator[Any]:
        return iter(self._items)

    @property
    def total(self) -> int:
        return self._total

    @property
    def start(self) -> int:
        return (self.page - 1) * self.limit

    @property
    def stop(self) -> int:
        return min(self.start + self.limit, self.total) if self.limit else self.total

    @property
    def count(self) -> int:
        return max(0, self.stop - self.start)

    @property
    def last_page(self) -> int:
        return max(1, math.ceil(self.total / self.limit)) if self.limit else 1

    @property
    def has_next(self) -> bool:
        return self.page < self.last_page

    @property
    def has_previous(self) -> bool:
        return self.page > 1


class QueryPager(Page):
    """A page of a query; the query runs when rows are read, and its count when the total is asked for."""

    def __init__(self, query: Any, limit: int = 100, page: int = 1):
        super().__init__(None, 0, limit, page)
        self._query = query.copy()
        self._result: Result | None = None
        self._counted: int | None = None

    def _settable(self) -> None:
        if self._result is not None:
            raise LockedResult("The page is already being read")

    def set_page(self, page: int) -> QueryPager:
        self._settable()
        if page < 1:
            raise QueryError("Pages are counted from 1")
        self.page = page
        return self

    def set_limit(self, limit: int) -> QueryPager:
        self._settable()
        self.limit = limit
        return self

    @property
    def total(self) -> int:
        if self._counted is None:
            self._counted = self._query.count_query().execute().fetch_field()
        return self._counted

    def __iter__(self) -> Iterator[Any]:
        if self._result is None:
            self._result = self._query.copy().page(self.limit, self.page).execute().rewindable()
        return iter(self._result)
