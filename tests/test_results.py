"""Reading results, pages, hydration, schema and statistics."""

import dataclasses
import datetime as dt

import pytest

from quern.errors import InvalidDataAccess, LockedResult, QueryError, TypeConversionError
from quern.plans.expressions import Raw, Value, Values
from quern.results import Page, expanded
from quern.session import Engine
from quern.sources.schema import Browser, Direction, Graph, Introspector, Visitor, human_count, human_size
from quern.streaming.windows import windowed
from tests.conftest import DATA

ROWS = [(7, "a"), (11, "a"), (7, "b"), (13, "a"), (13, "b")]


@pytest.fixture
def table(engine):
    engine.store.create("some_table", {"id": "serial", "foo": "int not null", "bar": "varchar(255)"}, primary_key=["id"])
    engine.insert("some_table").columns(["foo", "bar"]).query(Values(ROWS)).perform()
    return lambda **options: engine.select("some_table").order_by("id").execute(options=options)


def test_one_pass(table):
    found = table()
    assert len(list(found)) == 5 and list(found) == []


def test_rewindable(table):
    found = table(rewindable=True)
    part = [found.fetch() for _ in range(3)]
    assert [r["foo"] for r in found] == [7, 11, 7, 13, 13] and len(list(found)) == 5 and len(part) == 3


def test_fetching(table):
    found = table()
    assert found.fetch()["foo"] == 7 and found.fetch_field("foo") == 11 and found.fetch_field() == 3
    assert found.fetch_column("bar") == ["a", "b"] and found.fetch() is None and found.fetch_field() is None
    assert table().key_column("id").fetch_column("foo") == {1: 7, 2: 11, 3: 7, 4: 13, 5: 13}
    assert [k for k, _ in table(key="id").items()] == [1, 2, 3, 4, 5]
    with pytest.raises(InvalidDataAccess):
        table().key_column("nope")


def test_locked(table):
    found = table()
    found.fetch()
    for act in (lambda: found.key_column("id"), lambda: found.hydrate(dict), lambda: found.rewindable()):
        with pytest.raises(LockedResult):
            act()


def test_described(table):
    found = table()
    assert found.count_rows() == 5 and found.count_columns() == 3 and found.column_names() == ["id", "foo", "bar"]
    assert found.column_types() == {"id": "integer", "foo": "integer", "bar": "varchar"}
    assert found.column_number("bar") == 2 and found.column_name(0) == "id" and found.column_exists("foo")
    for act in (lambda: found.column_type("x"), lambda: found.column_name(9)):
        with pytest.raises(InvalidDataAccess):
            act()


def test_row(table):
    row = table().fetch()
    assert row.get(1) == 7 and row.get("foo", str) == "7" and row.raw("bar") == "a" and row.has("id") and not row.has("x")
    assert dict(row) == row.to_dict() == {"id": 1, "foo": 7, "bar": "a"}
    with pytest.raises(InvalidDataAccess):
        row["x"]
    with pytest.raises(TypeError):
        row["foo"] = 1
    with pytest.raises(TypeConversionError):
        row.get("bar", dt.date)


@dataclasses.dataclass
class Base:
    id: int


class Item(Base):
    def __init__(self):
        raise AssertionError("not called")


def test_hydration(table):
    item = table(**{"class": Item}).fetch()
    assert isinstance(item, Item) and (item.id, item.foo, item.bar) == (1, 7, "a")
    assert table(hydrator=lambda r: r["foo"] * 2).fetch_all() == [14, 22, 14, 26, 26]


def test_groups():
    assert expanded({"a.b.c": 1, "a.d": 2, "e": 3, "n.x": None}) == {"a": {"b": {"c": 1}, "d": 2}, "e": 3, "n": None}
    assert expanded({"n__x": None}, "__", drop_null_groups=False) == {"n": {"x": None}}


def test_pages(engine):
    for limit, page, expected in [(7, 3, (7, 14, 21, 23, True, True)), (50, 1, (50, 0, 50, 4, True, False)), (50, 4, (7, 150, 157, 4, False, True))]:
        p = Page([], 157, limit, page)
        assert (p.count, p.start, p.stop, p.last_page, p.has_next, p.has_previous) == expected
    with pytest.raises(QueryError):
        Page([], 1, 1, 0)
    numbers = engine.select(Values([[k] for k in range(20)], ["n"]), "t").column("t.n").order_by("t.n")
    pager = engine.pager(numbers, 6, 2)
    assert pager.total == 20 and pager.last_page == 4
    assert [r["n"] for r in pager] == [6, 7, 8, 9, 10, 11]
    with pytest.raises(LockedResult):
        pager.set_page(3)


def test_perform_only(table, engine):
    q = engine.select("some_table").perform_only().for_update()
    assert q.perform() == 5 and q.execute().fetch() is None


def test_arrays_and_binary(engine):
    engine.store.create("foo", {"id": "serial", "bar": "int[]", "baz": "varchar[]", "raw": "bytea", "at": "timestamp"})
    data = "åß∂ƒ©˙∆˚¬…æ".encode()
    engine.insert("foo").values({"bar": Value([7, 11, 42], "_int"), "raw": data}).perform()
    engine.insert("foo").values({"baz": Value(["beh", "bla"], "varchar[]"), "at": dt.datetime(2020, 11, 30, 9, 18, 27)}).perform()
    first, second = engine.select("foo").order_by("id").execute()
    assert first["bar"] == [7, 11, 42] and first["raw"] == data and second["baz"] == ["beh", "bla"]
    assert second["at"].isoformat() == "2020-11-30T09:18:27+00:00"


def test_typed_and_raw(engine):
    row = engine.execute("select '{\"a\": 1}' as j, ? as n, ?::date as d", [5, "2024-02-03"], {"types": {"j": "json"}}).fetch()
    assert row["j"] == {"a": 1} and row["n"] == 5 and row["d"] == dt.date(2024, 2, 3)
    assert engine.execute(engine.raw("select ? as x", [Raw("1 + 1")])).fetch_field() == 2


@pytest.fixture
def graph(engine):
    s = engine.store
    s.create("event_index", {"aggregate_id": "uuid", "aggregate_root": "uuid", "size": "decimal(10,2)"}, primary_key=["aggregate_id"], foreign_keys={"root": (["aggregate_root"], "event_index", ["aggregate_id"])})
    s.create("event_default", {"position": "bigserial", "aggregate_id": "uuid"}, primary_key=["position"], foreign_keys={"owner": (["aggregate_id"], "event_index", ["aggregate_id"])})
    s.create("message_broker", {"serial": "serial", "body": "bytea"}, primary_key=["serial"])
    s.create("other.place", {"a": "int"})
    return Introspector(s)


class Seen(Visitor):
    def __init__(self):
        self.names = []

    def table(self, table):
        self.names.append(table.name)


def test_introspection(graph):
    assert graph.tables() == ["event_default", "event_index", "message_broker"] and graph.tables("other") == ["place"]
    assert graph.schemas() == ["other", "public"] and graph.table_exists("place", "other") and not graph.table_exists("place")
    assert graph.current_database() in graph.databases()
    t = graph.table("event_index")
    assert t.primary_key.columns == ("aggregate_id",) and [k.name for k in t.reverse_foreign_keys] == ["root", "owner"]
    assert t.columns["aggregate_id"].nullable is False and t.columns["aggregate_root"].nullable
    assert t.identity == graph.table("event_index").identity != graph.table("event_default").identity


@pytest.mark.parametrize(("start", "way", "names"), [("event_default", Direction.NORMAL, ["event_default", "event_index"]), ("event_index", Direction.NORMAL, ["event_index"]), ("event_index", Direction.REVERSE, ["event_index", "event_default"])])
def test_browsing(graph, start, way, names):
    seen = Seen()
    Browser(graph, seen).browse_table(start, way)
    assert seen.names == names


def test_graphviz(graph):
    drawn = Graph()
    Browser(graph, drawn).browse_schema()
    assert '"event_default" -> "event_index" [label="aggregate_id"];' in drawn.text() and drawn.text().count("->") == 2


def test_human():
    assert human_count(999) == "999" and human_count(1500) == "1.5 K" and human_size(1536) == "1.5 KiB" and human_size(10) == "10 B"


def test_command(capsys, spark):
    from quern import cli

    assert cli.main([DATA, "inspect", "region"]) == 0 and "r_name varchar" in capsys.readouterr().out
    assert cli.main([DATA, "graph"]) == 0 and "digraph" in capsys.readouterr().out
    assert cli.main([DATA, "stat", "nation"]) == 0 and "n_name" in capsys.readouterr().out


def test_stream(spark, tmp_path):
    """The windows of a stream are those of the table, once the watermark has passed them."""
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "ts", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    counted = windowed(stream, "ts", "1 day", ["event_type"], {"n": "count(*)"}, late="1 hour")
    running = counted.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "ck")).start()
    running.processAllAvailable()
    running.stop()
    whole = windowed(events, "ts", "1 day", ["event_type"], {"n": "count(*)"})
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, whole.collect()))


def test_existing_session_is_used(spark):
    assert Engine(spark).spark is spark
