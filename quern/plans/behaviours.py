"""Registered queries for what is not one statement: typed windows and groups, operators, results, defaults, constraints, metadata.

Where a behaviour has no rows of its own, it is told as rows of facts, computed by the engine over the tables.
"""

from __future__ import annotations

import contextlib
import io
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame

from quern.errors import LockedResult, QuernError
from quern.plans.catalogue import query
from quern.plans.expressions import Cast, Raw, Value, Values
from quern.plans.queries import JoinMode, Order
from quern.session import Engine, SessionConfiguration
from quern.sources.schema import Browser, Direction, Graph, Introspector, Visitor


def _facts(e: Engine, shape: str, rows: Iterable[tuple]) -> DataFrame:
    return e.session.createDataFrame(list(rows), shape)


def _refused(work: Callable[[], Any]) -> str:
    """The kind of error that work ends with."""
    try:
        work()
    except QuernError as error:
        return type(error).__name__
    return "none"


# typed windows, groups and joins


@query("""select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place,
sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row) as running,
lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as next_key from orders""")
def window_typed(e):
    q = e.select("orders").column("o_orderkey").column_window("row_number()", "place", ["o_custkey"], [("o_totalprice", Order.DESC), "o_orderkey"])
    q.column_window("sum(o_totalprice)", "running", ["o_custkey"], ["o_orderkey"], ("rows", -2, 0))
    return q.column_window("lead(o_orderkey)", "next_key", ["o_custkey"], ["o_orderkey"])


@query("""select c_mktsegment, c_nationkey, count(*) as n, rank() over (partition by c_mktsegment order by count(*) desc) as place
from customer group by c_mktsegment, c_nationkey""")
def window_over_groups(e):
    q = e.select("customer").columns(["c_mktsegment", "c_nationkey"]).column_aggregate("count", alias="n").group_by("c_mktsegment").group_by("c_nationkey")
    return q.column_window("rank()", "place", ["c_mktsegment"], [(Raw("count(*)"), "desc")])


@query("select o_orderstatus, o_orderpriority, count(*) as n, sum(o_totalprice) as total from orders group by rollup (o_orderstatus, o_orderpriority)")
def rollup(e):
    q = e.select("orders").columns(["o_orderstatus", "o_orderpriority"]).column_aggregate("count", alias="n").column_aggregate("sum", "o_totalprice", "total")
    return q.rollup("o_orderstatus", "o_orderpriority")


@query("select p_brand, p_type, count(*) as n, max(p_size) as top from part group by cube (p_brand, p_type)", "cube")
def _cube(e):
    return e.select("part").columns(["p_brand", "p_type"]).column_aggregate("count", alias="n").column_aggregate("max", "p_size", "top").cube("p_brand", "p_type")


@query("select l_returnflag, l_linestatus, count(distinct l_suppkey) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_linestatus), ())")
def grouping_sets_typed(e):
    q = e.select("lineitem").columns(["l_returnflag", "l_linestatus"]).column_aggregate("count", "l_suppkey", "n", distinct=True)
    return q.grouping_sets(["l_returnflag", "l_linestatus"], ["l_linestatus"], [])


@query("select o_orderstatus, count(*) filter (where o_totalprice > 100000) as large from orders group by o_orderstatus")
def aggregate_filter_typed(e):
    return e.select("orders").column("o_orderstatus").column_aggregate("count", alias="large", where=lambda w: w.is_greater("o_totalprice", 100000)).group_by("o_orderstatus")


@query("select c_mktsegment, true as near from customer group by c_mktsegment")
def approximate_count(e):
    """The approximate number of distinct keys is within a tenth of the exact one."""
    inner = e.select("customer").column("c_mktsegment").column_aggregate("approx_count_distinct", "c_custkey", "about").column_aggregate("count", "c_custkey", "exact", distinct=True)
    return e.select(inner.group_by("c_mktsegment"), "t").column("t.c_mktsegment").column_expression("abs(t.about - t.exact) <= t.exact / 10", "near")


@query("select k, c_name, o_orderkey from (select c_custkey as k, c_name from customer) c join (select o_custkey as k, o_orderkey from orders) o using (k)")
def join_using(e):
    left = e.select("customer").column("c_custkey", "k").column("c_name")
    right = e.select("orders").column("o_custkey", "k").column("o_orderkey")
    return e.select(left, "c").column("k").column("c_name").column("o_orderkey").join_using(right, ["k"], "o")


@query("""select c.c_custkey, t.n, t.top from customer c left join
(select o_custkey, count(*) as n, max(o_totalprice) as top from orders group by o_custkey) t on t.o_custkey = c.c_custkey where t.n > 0""")
def join_lateral(e):
    inner = e.select("orders", "o").column_aggregate("count", alias="n").column_aggregate("max", "o.o_totalprice", "top").where_expression("o.o_custkey = c.c_custkey")
    return e.select("customer", "c").column("c.c_custkey").column("t.n").column("t.top").join_lateral(inner, "t").where("t.n", 0, ">")


@query("select n_nationkey, r_name from nation left join region on r_regionkey = n_regionkey and r_name like '%1'")
def join_using_left(e):
    left = e.select("nation").column("n_nationkey").column("n_regionkey", "k")
    right = e.select("region").column("r_regionkey", "k").column("r_name")
    right.get_where().is_like("r_name", "%1")
    return e.select(left, "a").column("n_nationkey").column("r_name").join_using(right, ["k"], "b", JoinMode.LEFT)


# operators that are passed on


@query("select n_name from nation where not regexp_matches(n_name, '[13579]$')")
def passed_not_regex(e):
    return e.select("nation").column("n_name").where("n_name", "[13579]$", "!~")


@query("select n_name from nation where regexp_matches(n_name, 'nation_1', 'i')")
def passed_regex_insensitive(e):
    return e.select("nation").column("n_name").where("n_name", "nation_1", "~*")


@query("select n_name from nation where n_name similar to 'NATION_(1|2)[0-9]*'")
def passed_similar(e):
    return e.select("nation").column("n_name").where("n_name", "NATION_(1|2)%", "similar to")


@query("select o_orderkey from orders where list_has_all([o_custkey % 3, o_custkey % 5], [1, 2])")
def passed_contains(e):
    return e.select("orders").column("o_orderkey").where(Raw("array(o_custkey % 3, o_custkey % 5)"), [1, 2], "@>")


@query("select o_orderkey from orders where list_has_any([o_custkey % 7, o_custkey % 11], [3, 4])")
def passed_overlaps(e):
    return e.select("orders").column("o_orderkey").where(Raw("array(o_custkey % 7, o_custkey % 11)"), [3, 4], "&&")


@query("select p_partkey from part where p_size >= 30")
def passed_as_it_is(e):
    """An operator that has no name of its own here."""
    return e.select("part").column("p_partkey").where("p_size", 30, "!<")


# projection and order that go again


@query("select r_name from region")
def columns_removed(e):
    q = e.select("region").columns(["r_regionkey", "r_name"]).remove_column("r_regionkey")
    return q if q.has_column("r_name") and not q.has_column("r_regionkey") else e.select("region")


@query("select r_regionkey as k, upper(r_name) as name from region")
def columns_of_all_kinds(e):
    return e.select("region").columns({"k": "r_regionkey", "name": lambda: Raw("upper(r_name)")})


@query("select n_nationkey from nation order by n_nationkey limit 5")
def order_removed(e):
    return e.select("nation").column("n_nationkey").order_by("n_name", Order.DESC).remove_all_order().order_by("n_nationkey").range(5)


@query("select (select count(*) from supplier) as n, 0 as fetched")
def perform_only(e):
    q = e.select("supplier").perform_only()
    return _facts(e, "n long, fetched long", [(q.perform(), len(q.execute().fetch_all()))])


@query("select * from (values ('empty', 'QueryError'), ('alias', 'QueryError'), ('page', 'QueryError'), ('join', 'QueryError'), ('none', 'none')) t(what, error)")
def refused(e):
    cases = {
        "empty": lambda: e.select("region").column(""), "alias": lambda: e.select("region", "a").join("nation", "true", "a"),
        "page": lambda: e.select("region").page(5, 0), "join": lambda: e.select().join("region", "true").frame(), "none": lambda: e.select("region").frame(),
    }
    return _facts(e, "what string, error string", [(k, _refused(f)) for k, f in cases.items()])


@query("select n_nationkey, n_name from nation where n_regionkey = 2")
def session_views(e):
    """A view of the given session is known to an engine made after it, and an engine's tables are not known to the session."""
    view = f"quern_seen_{uuid.uuid4().hex}"
    e.spark.createDataFrame([(2,)], "k long").createOrReplaceTempView(view)
    try:
        other = Engine(e.spark)
        other.store.register("nation", e.select("nation").frame())
        found = other.execute(f"select n_nationkey, n_name from nation where n_regionkey = (select k from {view})").frame
        return found if not e.spark.catalog.tableExists("nation") else found.limit(0)
    finally:
        e.spark.catalog.dropTempView(view)


@query("select (select count(*) from customer) as before, 1 as other, (select count(*) from customer) as after")
def engines_apart(e):
    """Two engines know different tables by one name."""
    other = Engine(e.spark)
    other.store.create("customer", {"a": "int"})
    count = lambda x: x.select("customer").execute().count_rows()
    before = count(e)
    other.insert("customer").values([1]).perform()
    return _facts(e, "before long, other long, after long", [(before, count(other), count(e))])


# values, types, functions


@query("""select event_id, cast(json_extract_string(props, '$.k') as int) + 1 as plus, map_extract(map(['a', 'b'], [event_id, user_id]), 'b')[1] as b,
cardinality(map(['a', 'b'], [event_id, user_id])) as n from events""")
def map_functions(e):
    q = e.select("events").column("event_id").column_expression("cast(from_json(props, 'map<string,string>')['k'] as int) + 1", "plus")
    q.column_expression("element_at(map(?, event_id, ?, user_id), ?)", "b", ["a", "b", "b"])
    return q.column_expression("cast(cardinality(map_from_arrays(array('a', 'b'), array(event_id, user_id))) as bigint)", "n")


@query("select r_name, hex(encode(r_name)) as hexed, md5(r_name) as digest, base64(encode(r_name)) as packed, octet_length(encode(r_name)) as bytes from region")
def binary_functions(e):
    q = e.select("region").column("r_name").column_expression("hex(encode(r_name, 'utf-8'))", "hexed").column_expression("md5(encode(r_name, 'utf-8'))", "digest")
    return q.column_expression("base64(encode(r_name, 'utf-8'))", "packed").column_expression("cast(octet_length(r_name) as bigint)", "bytes")


@query("select * from (values (1, 'deadbeef', 3), (2, '', 0)) t(id, hexed, n)")
def binary_values(e):
    e.store.create("blobs", {"id": "int", "data": "bytea", "items": "int[]"})
    e.insert("blobs").values([1, bytes.fromhex("deadbeef"), Value([7, 11, 42], "int[]")]).values([2, b"", Value([], "int[]")]).perform()
    return e.select("blobs").column("id").column_expression("lower(hex(data))", "hexed").column_expression("size(items)", "n")


@query("select 4 as up, 2 as even, 5 as bound, 3 as text")
def cast_bound_again(e):
    """A cast of an argument that another run replaces."""
    q = e.prepare(lambda b: b.select().column(Cast(Raw("?", [3.4]), "bigint"), "up"))
    rows = [(q.execute([4.4]).fetch_field(), q.execute([2.5]).fetch_field(), q.execute([5.2]).fetch_field(), q.execute([3]).fetch_field())]
    return _facts(e, "up long, even long, bound long, text long", rows)


@query("select r_regionkey, 'region ' || lower(r_name) as label from region")
def own_converter(e):
    """Values of a class of the user's own, in both directions."""

    class Label:
        def __init__(self, text: str):
            self.text = text

    other = Engine(e.spark)
    other.converter.register("varchar", Label, lambda x: x.text.upper(), lambda x: Label(x.lower()))
    other.store.register("region", e.select("region").frame())
    found = other.select("region").columns(["r_regionkey", "r_name"]).where("r_name", Label("none"), "<>").execute()
    return _facts(e, "r_regionkey long, label string", [(r.get("r_regionkey", int), "region " + r.get("r_name", Label).text) for r in found])


# changes


@query("select * from (values (1, 5, 'x'), (2, 9, 'x'), (3, 5, 'y')) t(id, a, b)")
def insert_defaults(e):
    e.store.create("d", {"id": "serial", "a": "integer", "b": "varchar"}, defaults={"a": "5", "b": "'x'"})
    e.insert("d").perform()
    e.insert("d").values({"a": 9}).perform()
    e.insert("d").columns(["b"]).values(["y"]).perform()
    return e.select("d")


@query("select r_name || '!' as label, r_regionkey as id from region")
def insert_columns(e):
    e.store.create("labels_of", {"id": "bigint", "label": "varchar"})
    e.insert_query("labels_of").columns(["label", "id"]).query(e.select("region").column_expression("r_name || '!'").column("r_regionkey")).perform()
    return e.select("labels_of").columns(["label", "id"])


@query("""select 2 as inserted, (select count(*) from supplier where s_acctbal < 0) as updated, (select count(*) from supplier where s_nationkey < 10) as deleted,
(select count(*) from supplier where s_nationkey >= 10) + 2 as remain""")
def affected_counts(e):
    inserted = e.insert("supplier").columns(["s_suppkey", "s_nationkey"]).values([-1, 50]).values([-2, 51]).perform()
    updated = e.update("supplier").set("s_name", "owes").where("s_acctbal", 0, "<").perform()
    deleted = e.delete("supplier").where("s_nationkey", 10, "<").perform()
    return _facts(e, "inserted long, updated long, deleted long, remain long", [(inserted, updated, deleted, e.select("supplier").execute().count_rows())])


@query("""select 5 as r_regionkey, 'five' as r_name union all select r_regionkey, case when r_regionkey = 1 then 'one' else r_name end from region""")
def merge_by_key(e):
    e.upsert_values("region").set_key(["r_regionkey"]).set_using_alias("incoming").on_conflict("update").columns(["r_regionkey", "r_name"]).values([1, "one"]).values([5, "five"]).perform()
    return e.select("region")


@query("select r_regionkey, r_name from region union all select * from (values (null, 'a'), (null, 'a')) t(k, v)")
def merge_null_keys(e):
    """Rows without a key meet nothing."""
    e.store.constrain("region", primary_key=("r_regionkey",))
    for _ in range(2):
        with contextlib.suppress(QuernError):
            e.merge("region").on_conflict_ignore().columns(["r_regionkey", "r_name"]).query(Values([[Value(None, "bigint"), "a"]])).perform()
    return e.select("region")


@query("select * from (values ('twice', 'UniqueViolation'), ('dotted', 'QueryError'), ('undecided', 'QueryError'), ('mode', 'QueryError')) t(what, error)")
def merge_refused(e):
    cases = {
        "twice": lambda: e.merge("region").on_conflict_update("r_regionkey").columns(["r_regionkey"]).values([7]).values([7]).perform(),
        "dotted": lambda: e.merge("region").set_key("region.r_regionkey"), "undecided": lambda: e.merge("region").values([1, "x"]).perform(),
        "mode": lambda: e.merge("region").on_conflict("replace"),
    }
    return _facts(e, "what string, error string", [(k, _refused(f)) for k, f in cases.items()])


@query("""select * from (values ('null', 'NotNullViolation'), ('foreign', 'ForeignKeyViolation'), ('unique', 'UniqueViolation'), ('referred', 'ForeignKeyViolation'),
('moved', 'ForeignKeyViolation'), ('table', 'TableDoesNotExist'), ('ambiguous', 'AmbiguousIdentifier'), ('fine', 'none')) t(what, error)""")
def constraint_errors(e):
    """What a change that would break a constraint ends with; the tables stay as they are."""
    s = e.store
    s.constrain("nation", primary_key=("n_nationkey",))
    s.create("town", {"id": "int", "nation": "bigint not null"}, primary_key=["id"], foreign_keys={"of": (["nation"], "nation", ["n_nationkey"])})
    town = lambda *v: lambda: e.insert("town").columns(["id", "nation"]).values(list(v)).perform()
    cases = {
        "fine": town(1, 3), "null": town(2, None), "foreign": town(2, 1000), "unique": town(1, 4),
        "referred": lambda: e.delete("nation").where("n_nationkey", 3).perform(), "moved": lambda: e.update("nation").set("n_nationkey", 1003).where("n_nationkey", 3).perform(),
        "table": lambda: e.select("nowhere").frame(), "ambiguous": lambda: e.select("nation", "a").from_("nation", "b").column("n_name").frame(),
    }
    return _facts(e, "what string, error string", [(k, _refused(f)) for k, f in cases.items()])


@query("select * from (values ('immediate', 'UniqueViolation'), ('commit', 'UniqueViolation'), ('after', 'none')) t(step, error)")
def deferral(e):
    e.store.create("seat", {"a": "int"}, unique={"one_a": ["a"]}, deferrable=["one_a"])
    add = lambda: e.insert("seat").values([1]).perform()
    add()
    first = e.begin()
    out = [("immediate", _refused(add))]
    first.rollback()
    second = e.begin().deferred()
    add()
    out.append(("commit", _refused(second.commit)))
    return _facts(e, "step string, error string", [*out, ("after", _refused(lambda: e.select("seat").execute().fetch_all()))])


@query("select r_regionkey, case when r_regionkey = 2 then 'two' else r_name end as r_name from region where r_regionkey <> 4")
def transaction_commit(e):
    with e.begin() as pending:
        e.update("region").set("r_name", "two").where("r_regionkey", 2).perform()
        e.delete("region").where("r_regionkey", 4).perform()
        pending.commit()
    return e.select("region")


# metadata


@query("""select table_name, cast(count(*) as bigint) as columns from information_schema.columns where table_name in ('region', 'nation', 'customer', 'orders', 'lineitem')
group by table_name""")
def tables_listed(e):
    known = Introspector(e.store)
    found = [n for n in known.tables() if n in ("region", "nation", "customer", "orders", "lineitem") and known.table_exists(n)]
    return _facts(e, "table_name string, columns long", [(n, len(known.table(n).columns)) for n in found])


@query("""select column_name, case data_type when 'BIGINT' then 'bigint' when 'VARCHAR' then 'varchar' when 'DOUBLE' then 'double' when 'INTEGER' then 'integer' else lower(data_type) end as sql_type
from information_schema.columns where table_name = 'customer'""")
def columns_described(e):
    return _facts(e, "column_name string, sql_type string", [(c.name, c.sql_type) for c in Introspector(e.store).table("customer").columns.values()])


def _related(e: Engine) -> Introspector:
    s = e.store
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey")):
        s.load(name)
        s.constrain(name, primary_key=(key,))
    from quern.sources.store import ForeignKey

    s.constrain("nation", foreign_keys=(ForeignKey("in_region", ("n_regionkey",), "region", ("r_regionkey",)),))
    s.constrain("customer", foreign_keys=(ForeignKey("in_nation", ("c_nationkey",), "nation", ("n_nationkey",)),))
    return Introspector(s)


@query("select * from (values ('customer', 'in_nation', 'nation', 0), ('nation', 'in_region', 'region', 1), ('region', null, null, 1)) t(table_name, foreign_key, target, referring)")
def keys_described(e):
    known = _related(e)
    rows = []
    for name in ("customer", "nation", "region"):
        t = known.table(name)
        key = t.foreign_keys[0] if t.foreign_keys else None
        rows.append((name, key and key.name, key and key.target, len(t.reverse_foreign_keys)))
    return _facts(e, "table_name string, foreign_key string, target string, referring int", rows)


@query("select * from (values (0, 'customer'), (1, 'nation'), (2, 'region'), (10, 'region'), (11, 'nation'), (12, 'customer')) t(place, visited)")
def schema_walk(e):
    class Names(Visitor):
        def __init__(self) -> None:
            self.names: list[str] = []

        def table(self, table: Any) -> None:
            self.names.append(table.name)

    known, down, up = _related(e), Names(), Names()
    Browser(known, down).browse_table("customer")
    Browser(known, up).browse_table("region", Direction.REVERSE)
    return _facts(e, "place int, visited string", [*enumerate(down.names), *((10 + k, n) for k, n in enumerate(up.names))])


@query("select 3 as nodes, 2 as edges")
def schema_graph(e):
    drawn = Graph()
    Browser(_related(e), drawn).browse_table("customer")
    lines = drawn.text().split("\n")
    return _facts(e, "nodes int, edges int", [(sum("[label=\"" in x and "->" not in x for x in lines), sum("->" in x for x in lines))])


@query("select 'nation' as table_name, 3 as columns, 'n_name varchar' as second")
def command_line(e):
    from quern import cli

    folder = e.store.path_of("nation").rsplit("/", 1)[0]
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        cli.main([folder, "inspect", "nation"])
    name, *columns = out.getvalue().strip().split("\n")
    return _facts(e, "table_name string, columns int, second string", [(name, len(columns), columns[1].strip())])


# results


@query("""select (select count(*) from nation) as n, (select min(n_nationkey) from nation) as field, (select sum(n_nationkey) from nation) as total, 2 as columns,
(select max(n_name) from nation) as last_name, true as locked, (select count(*) from nation) as again""")
def result_access(e):
    q = e.select("nation").columns(["n_nationkey", "n_name"]).order_by("n_nationkey")
    field, once, twice = q.execute().fetch_field(), q.execute(), q.execute(None, {"rewindable": True})
    keys = q.execute().fetch_column("n_nationkey")
    by_key = q.execute(None, {"key": "n_nationkey"}).fetch_column("n_name")
    once.fetch()
    try:
        once.rewindable()
        locked = False
    except LockedResult:
        locked = True
    len(list(twice))
    return _facts(
        e, "n long, field long, total long, columns int, last_name string, locked boolean, again long",
        [(q.execute().count_rows(), field, sum(keys), once.count_columns(), max(by_key.values()), locked, len(list(twice)))],
    )


@query("select 'n_nationkey' as name, 'integer' as type, 0 as place, true as there union all select 'n_name', 'varchar', 1, true union all select 'nope', null, null, false")
def result_described(e):
    r = e.select("nation").columns(["n_nationkey", "n_name"]).execute()
    rows = [(n, r.column_type(n), r.column_number(n), True) if r.column_exists(n) else (n, None, None, False) for n in ("n_nationkey", "n_name", "nope")]
    return _facts(e, "name string, type string, place int, there boolean", rows)


@query("select n_nationkey as id, n_name as label, r_name as region from nation join region on r_regionkey = n_regionkey where n_nationkey < 8")
def result_hydrated(e):
    """Rows as objects of a class, with a group of columns as a nested one."""
    from quern.results import expanded

    q = e.select("nation", "n").column("n.n_nationkey", "id").column("n.n_name", "label").column("r.r_name", "region.name").join("region", "r.r_regionkey = n.n_regionkey", "r")
    found = q.where("n.n_nationkey", 8, "<").execute(None, {"hydrator": lambda row: expanded(row.to_dict())}).fetch_all()
    return _facts(e, "id long, label string, region string", [(x["id"], x["label"], x["region"]["name"]) for x in found])


@query("select n_nationkey, n_name from nation where n_nationkey = 7")
def result_of_class(e):
    class Nation:
        n_nationkey: int
        n_name: str

    found = e.select("nation").columns(["n_nationkey", "n_name"]).where("n_nationkey", 7).option("class", Nation).execute().fetch()
    return _facts(e, "n_nationkey long, n_name string", [(found.n_nationkey, found.n_name)])


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where event_id < 40")
def result_types(e):
    """A column read as another type than its own."""
    found = e.select("events").columns(["event_id", "props"]).where("event_id", 40, "<").execute(None, {"types": {"props": "json"}})
    return _facts(e, "event_id long, k long", [(r["event_id"], int(r["props"]["k"])) for r in found])


@query("select 'marked' as identifier, true as timed, true as planned")
def result_profile(e):
    seen = []
    e.watch(seen.append)
    r = e.select("region").identified("marked").execute(None, {"debug": True})
    r.fetch_all()
    return _facts(e, "identifier string, timed boolean, planned boolean", [(seen[0].identifier, r.profile.prepare > 0, "region" in r.profile.sql and "Scan parquet" in r.profile.plan)])


@query("select true as returning, 'Europe/Paris' as zone, '3' as partitions")
def session_settings(e):
    other = Engine(e.spark, configuration=SessionConfiguration("Europe/Paris", settings={"spark.sql.shuffle.partitions": "3"}))
    return _facts(e, "returning boolean, zone string, partitions string", [(other.supports_returning, str(other.converter.zone), other.session.conf.get("spark.sql.shuffle.partitions"))])


# sources


@query("select n_nationkey, n_name from nation where n_nationkey > 5")
def source_csv(e):
    folder = f"{e.store.root}/csv-{uuid.uuid4().hex}"
    e.select("nation").columns(["n_nationkey", "n_name"]).frame().write.csv(folder, header=True)
    e.store.source("nation_csv", "csv", folder, header=True, schema="n_nationkey long, n_name string")
    return e.select("nation_csv").columns(["n_nationkey", "n_name"]).where("n_nationkey", 5, ">")


@query("select n_nationkey, n_name from nation where n_regionkey = 3")
def source_orc(e):
    folder = f"{e.store.root}/orc-{uuid.uuid4().hex}"
    e.select("nation").frame().write.orc(folder)
    e.store.source("nation_orc", "orc", folder)
    return e.select("nation_orc").columns(["n_nationkey", "n_name"]).where("n_regionkey", 3)
