"""Values in both directions."""

import datetime as dt
import uuid
from decimal import Decimal
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.errors import TypeConversionError
from quern.functions.texts import format_array, format_interval, format_row, parse_array, parse_interval, parse_row
from quern.functions.types import Converter, canonical, spark_type

C = Converter("Europe/Paris")


@pytest.mark.parametrize(
    ("kind", "value", "expected"),
    [
        ("int2", "12", 12), ("integer", "-12", -12), ("bigserial", "1e3", 1000), ("int8", 2.5, 2), ("numeric", "12.3456789", Decimal("12.3456789")),
        ("float4", "42", 42.0), ("double precision", "-1.5e3", -1500.0), ("text", 5, "5"), ("bool", "t", True), ("bool", "f", False), ("boolean", True, True),
        ("bytea", "é", "é".encode()), ("date", "2020-11-30", dt.date(2020, 11, 30)), ("json", '{"a": [1]}', {"a": [1]}),
        ("uuid", "0e2a3e0e-a40a-4a4c-8d2f-4d8a5c7f9d6e", uuid.UUID("0e2a3e0e-a40a-4a4c-8d2f-4d8a5c7f9d6e")), ("_int", "{1,2,NULL}", [1, 2, None]),
        ("varchar[]", '{a,"b,c"}', ["a", "b,c"]), ("int[][]", "{{1},{2}}", [[1], [2]]), ("null", "x", None),
    ],
)
def test_from_sql(kind, value, expected):
    assert C.from_sql(value, kind) == expected


def test_round_trips():
    for kind, value in [("json", {"a": 1}), ("uuid", uuid.uuid4()), ("bool", False), ("bytea", "åß∂ƒ©˙∆˚¬…æ".encode()), ("time", dt.time(9, 18, 27)), ("int[]", [7, 11, 42])]:
        back = C.from_sql(C.to_sql(value, kind), kind)
        assert back == value


def test_time_zones():
    moment = dt.datetime(2020, 11, 30, 9, 18, 27, tzinfo=ZoneInfo("Indian/Christmas"))
    written = Converter("UTC").to_sql(moment, "timestamp")
    assert written == dt.datetime(2020, 11, 30, 2, 18, 27)
    assert Converter("UTC").from_sql(written, "timestamp").astimezone(ZoneInfo("Europe/Paris")).isoformat() == "2020-11-30T03:18:27+01:00"
    tahiti = Converter("Pacific/Tahiti")
    assert tahiti.from_sql(tahiti.to_sql(moment, "timestamp"), "timestamp").isoformat() == "2020-11-29T16:18:27-10:00"
    for text in ("2020-11-30 09:18:27.123456+01:00", "2020-11-30 09:18:27+01", "2020-11-30 09:18:27.5", "2020-11-30 09:18:27"):
        assert C.from_sql(text, "timestamptz").tzinfo is not None
    for text in ("09:18:27.123456+01:00", "09:18:27+01:00", "09:18:27.5", "09:18:27"):
        assert C.from_sql(text, "time").hour == 9


@pytest.mark.parametrize(("kind", "value"), [("int", "x"), ("int2", 70000), ("bool", "maybe"), ("date", "no"), ("uuid", "1"), ("int[]", 5), ("time", 5)])
def test_refused(kind, value):
    with pytest.raises(TypeConversionError):
        C.to_sql(value, kind)


def test_asked_type():
    assert C.from_sql(5, "int", str) == "5" and C.from_sql("5", "varchar", bytes) == b"5"
    with pytest.raises(TypeConversionError):
        C.from_sql("a", "varchar", dict)


def test_own_converters():
    class Point(tuple):
        pass

    own = Converter()
    own.register("varchar", Point, lambda p: f"{p[0]};{p[1]}", lambda s: Point(map(int, s.split(";"))))
    assert own.to_sql(Point((1, 2)), "varchar") == "1;2"
    assert own.from_sql("1;2", "varchar", Point) == (1, 2)


@pytest.mark.parametrize(
    ("text", "iso"),
    [("1 year 2 days 00:01:00", "P1Y2DT1M"), ("02:01:30", "PT2H1M30S"), ("2 hour 1 minute 30 second", "PT2H1M30S"), ("P1Y2M3DT4H5M6S", "P1Y2M3DT4H5M6S"), ("1 year 2 mons", "P1Y2M"), ("1.5 sec", "PT1.5S")],
)
def test_intervals(text, iso):
    assert format_interval(text) == iso
    assert parse_interval(iso) == parse_interval(text)


@pytest.mark.parametrize("text", ["", "P", "abc", "1 fortnight", "12:", "year"])
def test_bad_intervals(text):
    with pytest.raises(TypeConversionError):
        parse_interval(text)


def test_rows_as_text():
    assert parse_row('(1,"a ""b""",,"x,y",(2,3))') == ["1", 'a "b"', None, "x,y", ["2", "3"]]
    for bad in ("1,2", "(1", "(1)2", '("a)'):
        with pytest.raises(TypeConversionError):
            parse_row(bad)


@pytest.mark.parametrize("text", ["a", "{a", "{a}b", '{"a}', "{a,{b}"])
def test_bad_arrays(text):
    with pytest.raises(TypeConversionError):
        parse_array(text)


@given(st.lists(st.text() | st.none()))
def test_array_text_round_trips(items):
    assert parse_array(format_array(items)) == items


@given(st.lists(st.text(min_size=1) | st.none(), min_size=1))
def test_row_text_round_trips(items):
    assert parse_row(format_row(items)) == items


def test_type_names():
    assert spark_type("double precision") == "double" and spark_type("_int4") == "array<int>" and spark_type("decimal(10,2)") == "decimal(10,2)"
    assert canonical("character varying[]") == "varchar[]" and spark_type("timestamp with time zone") == "timestamp"
