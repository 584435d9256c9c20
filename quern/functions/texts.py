"""Text forms of arrays, rows and intervals."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from typing import Any

from quern.errors import TypeConversionError


class _Reader:
    """A cursor over text that reads quoted and bare items."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self) -> TypeConversionError:
        return TypeConversionError(f"malformed at {self.at}: {self.text!r}")

    def peek(self) -> str:
        if self.at >= len(self.text):
            raise self.fail()
        return self.text[self.at]

    def quoted(self) -> str:
        out, self.at = [], self.at + 1
        while (c := self.peek()) != '"' or self.text[self.at + 1 : self.at + 2] == '"':
            if c in '\\"':
                self.at += 1
                c = self.peek()
            out.append(c)
            self.at += 1
        self.at += 1
        return "".join(out)

    def bare(self, stops: str, opens: str) -> str:
        out = []
        while (c := self.peek()) not in stops:
            if c == "\\":
                self.at += 1
                c = self.peek()
            elif c in ('"', opens):
                raise self.fail()
            out.append(c)
            self.at += 1
        return "".join(out)


#: An array without nesting, escapes and blanks outside quotes, and its items: quoted or bare.
_PLAIN = re.compile(r'\{(?:"[^"\\]*"|[^\s"\\{},]+)(?:,(?:"[^"\\]*"|[^\s"\\{},]+))*\}').fullmatch
_ITEMS = re.compile(r'"([^"\\]*)"|([^"{},]+)').findall


def parse_array(text: str) -> list:
    """{a,"b c",{d}} as nested lists of strings, NULL as None."""
    if _PLAIN(text):
        return [None if bare and bare.upper() == "NULL" else bare or quoted for quoted, bare in _ITEMS(text)]
    reader = _Reader(text.strip())
    out = _array(reader)
    if reader.at != len(reader.text):
        raise reader.fail()
    return out


def _array(reader: _Reader) -> list:
    if reader.peek() != "{":
        raise reader.fail()
    reader.at += 1
    out: list[Any] = []
    if reader.peek() == "}":
        reader.at += 1
        return out
    while True:
        while reader.peek() == " ":
            reader.at += 1
        if reader.peek() == "{":
            out.append(_array(reader))
        elif reader.peek() == '"':
            out.append(reader.quoted())
        else:
            item = reader.bare(",}", "{").strip()
            out.append(None if item.upper() == "NULL" else item)
        if reader.peek() not in ",}":
            raise reader.fail()
        end = reader.peek() == "}"
        reader.at += 1
        if end:
            return out


def parse_row(text: str) -> list:
    """(a,"b c",) as a list of strings; an empty item is None, a nested row a list."""
    reader = _Reader(text.strip())
    out = _row(reader)
    if reader.at != len(reader.text):
        raise reader.fail()
    return out


def _row(reader: _Reader) -> list:
    if reader.peek() != "(":
        raise reader.fail()
    reader.at += 1
    out: list[Any] = []
    while True:
        if reader.peek() == '"':
            out.append(reader.quoted())
        elif reader.peek() == "(":
            out.append(_row(reader))
        else:
            out.append(reader.bare(",)", "(") or None)
        if reader.peek() not in ",)":
            raise reader.fail()
        end = reader.peek() == ")"
        reader.at += 1
        if end:
            return out


def _quote(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def format_array(items: list | tuple) -> str:
    def one(x: Any) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, (list, tuple)):
            return format_array(x)
        text = str(x)
        return _quote(text) if not text or text.upper() == "NULL" or re.search(r'[\s,{}"\\]', text) else text

    return "{" + ",".join(map(one, items)) + "}"


def format_row(items: list | tuple) -> str:
    def one(x: Any) -> str:
        if x is None:
            return ""
        text = format_row(x) if isinstance(x, (list, tuple)) else str(x)
        return _quote(text) if not text or re.search(r'[\s,()"\\]', text) else text

    return "(" + ",".join(map(one, items)) + ")"


@dataclass(frozen=True)
class Interval:
    """Calendar and clock parts that don't convert into each other."""

    years: int = 0
    months: int = 0
    days: int = 0
    hours: int = 0
    minutes: int = 0
    seconds: float = 0

    def iso(self) -> str:
        def part(value: float, letter: str) -> str:
            return f"{value:g}{letter}" if value else ""

        day = part(self.years, "Y") + part(self.months, "M") + part(self.days, "D")
        clock = part(self.hours, "H") + part(self.minutes, "M") + part(self.seconds, "S")
        return "P" + day + ("T" + clock if clock else "") if day or clock else "PT0S"


_UNITS = {"y": "years", "year": "years", "mon": "months", "month": "months", "w": "weeks", "week": "weeks", "d": "days", "day": "days", "h": "hours", "hour": "hours", "m": "minutes", "min": "minutes", "minute": "minutes", "s": "seconds", "sec": "seconds", "second": "seconds"}
_ISO = re.compile(r"P(?:(-?\d+)Y)?(?:(-?\d+)M)?(?:(-?\d+)W)?(?:(-?\d+)D)?(?:T(?:(-?\d+)H)?(?:(-?\d+)M)?(?:(-?\d+(?:\.\d+)?)S)?)?")


def parse_interval(value: Any) -> Interval:
    """ISO-8601, HH:MM:SS, number-unit pairs, or a mixture of the last two."""
    if isinstance(value, Interval):
        return value
    if isinstance(value, dt.timedelta):
        seconds = value.total_seconds() - value.days * 86_400
        return Interval(0, 0, value.days, int(seconds // 3600), int(seconds % 3600 // 60), seconds % 60)
    text, parts = str(value).strip(), dict.fromkeys(("years", "months", "days", "hours", "minutes", "seconds"), 0.0)
    if found := _ISO.fullmatch(text):
        if not any(found.groups()):
            raise TypeConversionError(f"{value!r} is no interval")
        y, mo, w, d, h, mi, s = (float(x or 0) for x in found.groups())
        parts = {"years": y, "months": mo, "days": d + 7 * w, "hours": h, "minutes": mi, "seconds": s}
    else:
        rest = re.sub(r"(?<!\S)(-?)(\d+):(\d{1,2})(?::(\d{1,2}(?:\.\d+)?))?(?!\S)", lambda m: _clock(m, parts), text)
        rest = re.sub(r"(?<![\w.])([+-]?\d+(?:\.\d+)?)\s*([a-z]+)", lambda m: _unit(m, parts), rest, flags=re.I)
        if rest.strip(" ,") or rest == text:
            raise TypeConversionError(f"{value!r} is no interval")
    return Interval(*(int(parts[k]) for k in list(parts)[:5]), parts["seconds"])


def _clock(found: re.Match, parts: dict[str, float]) -> str:
    sign = -1 if found[1] else 1
    for key, text in zip(("hours", "minutes", "seconds"), found.groups()[1:], strict=True):
        parts[key] += sign * float(text or 0)
    return ""


def _unit(found: re.Match, parts: dict[str, float]) -> str:
    name = found[2].lower()
    unit = _UNITS.get(name) or _UNITS.get(name.removesuffix("s"))
    if unit is None:
        return found[0]
    if unit == "weeks":
        parts["days"] += 7 * float(found[1])
    else:
        parts[unit] += float(found[1])
    return ""


def format_interval(value: Any) -> str:
    return parse_interval(value).iso()
