"""One query for each operator over the bundled tables, and SQL that gives the same rows elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans.expressions import Cast, ColumnRef, Identifier, Raw, Row, Value, Values
from quern.plans.queries import JoinMode, Nulls, Order
from quern.session import Engine

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

QUERIES: dict[str, Callable[[Engine], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a query under its function's name, with the SQL that it must agree with."""

    def add(f: Callable[[Engine], object]) -> Callable:
        key = name or f.__name__.rstrip("_")

        def run(engine: Engine) -> DataFrame:
            found = f(engine)
            return found if isinstance(found, DataFrame) else found.frame()  # type: ignore[attr-defined]

        QUERIES[key], ORACLE_SQL[key] = run, sql
        return f

    return add


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine.over(spark, sf_dir, TABLES)


# flagship


@query("""select c.c_custkey, c.c_mktsegment, count(o.o_orderkey) as order_count
from customer c left join orders o on o.o_custkey = c.c_custkey
where c.c_acctbal > 0 and c.c_nationkey in (1, 2, 3, 4, 5)
group by c.c_custkey, c.c_mktsegment having count(o.o_orderkey) < 20
order by c.c_mktsegment asc, count(o.o_orderkey) desc, c.c_custkey asc limit 7 offset 3""")
def flagship(e):
    return (
        e.select("customer", "c")
        .column("c.c_custkey").column("c.c_mktsegment").column_expression("count(o.o_orderkey)", "order_count")
        .left_join("orders", "o.o_custkey = c.c_custkey", "o")
        .where("c.c_acctbal", 0, ">").where("c.c_nationkey", [1, 2, 3, 4, 5])
        .group_by("c.c_custkey").group_by("c.c_mktsegment")
        .having_expression("count(o.o_orderkey) < ?", [20])
        .order_by("c.c_mktsegment").order_by_expression("count(o.o_orderkey)", Order.DESC).order_by("c.c_custkey")
        .range(7, 3)
    )


# scans


@query("select r_regionkey, r_name from region")
def scan_table(e):
    return e.select("region").columns(["r_regionkey", "r_name"])


@query("select 1 as one, 'x' as label, cast(null as varchar) as nothing")
def scan_no_from(e):
    return e.select().column_value(1, "one", "int").column_value("x", "label").column_value(None, "nothing", "varchar")


@query("select * from (values (1,'a'),(2,'b')) as t(id,label)")
def scan_values(e):
    return e.select(Values([[1, "a"], [2, "b"]], ["id", "label"]), "t").column_expression("cast(t.id as int)", "id").column("t.label")


@query("select * from (values ('1','a'),('x','2')) as t(k,v)")
def values_mixed(e):
    return e.select(Values([[1, "a"], ["x", 2]], ["k", "v"]), "t")


@query("select a as x, b as y from (values (1,'p'),(2,'q')) as t(a,b)")
def values_col_alias(e):
    rows = Values().row([1, "p"]).row([2, "q"]).columns(["a", "b"])
    return e.select(rows, "t").column(lambda: Cast(ColumnRef("t.a"), "int"), "x").column("t.b", "y")


@query("select d.seg, d.n from (select c_mktsegment as seg, count(*) as n from customer group by c_mktsegment) as d where d.n > 10")
def derived_table(e):
    inner = e.select("customer").column("c_mktsegment", "seg").column_expression("count(*)", "n").group_by("c_mktsegment")
    return e.select(inner, "d").column("d.seg").column("d.n").where("d.n", 10, ">")


@query("select n.n_name, r.r_name from nation n, region r where n.n_regionkey = r.r_regionkey")
def multi_from(e):
    return e.select("nation", "n").from_("region", "r").column("n.n_name").column("r.r_name").where("n.n_regionkey", ColumnRef("r.r_regionkey"))


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 1000 and o_orderstatus = 'F' order by o_orderkey limit 50")
def raw_query(e):
    return e.raw("select o_orderkey, o_totalprice from orders where o_totalprice > ? and o_orderstatus = ?::varchar order by o_orderkey limit 50", [1000, "F"])


@query("select a.n_name as x, b.r_name as y from nation a join region b on a.n_regionkey = b.r_regionkey")
def alias_registry(e):
    q = e.select("nation").join("region", Raw("nation.n_regionkey = region.r_regionkey"))
    return q.column("nation.n_name", "x").column("region.r_name", "y")


# projection


@query("select c_custkey, c_name as name from customer")
def project_column(e):
    return e.select("customer").column("c_custkey").column("customer.c_name", "name")


@query("select o_orderkey as k, o_custkey from orders")
def project_columns(e):
    return e.select("orders").columns({"k": "o_orderkey", 0: "o_custkey"})


@query("select o_orderkey, o_totalprice * 2 as dbl, case when o_orderstatus='F' then 1 else 0 end as is_f from orders")
def project_expression(e):
    q = e.select("orders").column("o_orderkey").column_expression("o_totalprice * ?", "dbl", [2])
    return q.column_expression("case when o_orderstatus = ? then ? else ? end", "is_f", ["F", Value(1, "int"), Value(0, "int")])


@query("select r.*, n.n_name from region r join nation n on n.n_regionkey = r.r_regionkey")
def project_star(e):
    return e.select("region", "r").column("r.*").column("n.n_name").join("nation", "n.n_regionkey = r.r_regionkey", "n")


@query("select r_name, cast(7 as bigint) as seven, date '2024-01-02' as day, cast(1.5 as double) as half from region")
def project_value(e):
    return e.select("region").column("r_name").column_value("7", "seven", "bigint").column_value("2024-01-02", "day", "date").column_value(1.5, "half", "double")


@query("select o_orderkey, cast(o_custkey as varchar) as cust_s, cast(o_orderkey as double) as key_d from orders")
def cast(e):
    q = e.select("orders").column("o_orderkey")
    return q.column_expression(Cast(ColumnRef("o_custkey"), "varchar"), "cust_s").column_expression(Cast(ColumnRef("o_orderkey"), "double precision"), "key_d")


@query("select p_partkey, cast(round_even(p_retailprice, 0) as bigint) as price from part")
def cast_rounds(e):
    return e.select("part").column("p_partkey").column_expression(Cast(ColumnRef("p_retailprice"), "bigint"), "price")


@query("select n_nationkey, 'a' as first, n_name as second from nation")
def project_row(e):
    inner = e.select("nation").column("n_nationkey").column_expression(Row(["a", ColumnRef("n_name")]), "r")
    return e.select(inner, "t").column("t.n_nationkey").column_expression("t.r.col1", "first").column_expression("t.r.n_name", "second")


@query("select r.r_name, (select count(*) from nation n where n.n_regionkey = r.r_regionkey) as nations from region r")
def scalar_subquery_project(e):
    inner = e.select("nation", "n").column_expression("count(*)").where_expression("n.n_regionkey = r.r_regionkey")
    return e.select("region", "r").column("r.r_name").column_expression(inner, "nations")


@query("select r_name, (select v from (values ('only')) t(v)) as v from region")
def values_project(e):
    return e.select("region").column("r_name").column_expression(Values([["only"]]), "v")


@query("select o_orderkey, 'what?' as mark, o_custkey + 3 as k from orders where o_orderpriority = '1-URGENT'")
def raw_expression(e):
    q = e.select("orders").column("o_orderkey").column_expression("'what?'", "mark").column_expression("? + ?", "k", [ColumnRef("o_custkey"), 3])
    return q.where_expression("o_orderpriority = ?::varchar", ["1-URGENT"])


@query("select c_custkey, c_acctbal from customer where c_acctbal > 100 and c_mktsegment = 'BUILDING'")
def callable_arguments(e):
    q = e.select("customer").column(lambda: ColumnRef("c_custkey")).column(lambda s: s and "c_acctbal")
    return q.where("c_acctbal", lambda w: 100, ">").where(lambda w: w.is_equal("c_mktsegment", "BUILDING") and None)


# predicates

_C = "select c_custkey from customer where "


def _customers(e):
    return e.select("customer").column("c_custkey")


@query(_C + "c_mktsegment = 'BUILDING'")
def filter_eq(e):
    return _customers(e).where("c_mktsegment", "BUILDING")


@query(_C + "c_mktsegment <> 'BUILDING'")
def filter_ne(e):
    return _customers(e).where("c_mktsegment", "BUILDING", "<>")


@query("select p_partkey from part where p_size >= 10 and p_size < 20 and p_size <> 15")
def filter_cmp(e):
    q = e.select("part").column("p_partkey")
    q.get_where().is_greater_or_equal("p_size", 10).is_less("p_size", 20).is_not_equal("p_size", 15)
    return q


@query("select o_orderkey from orders where o_orderstatus in ('F','P')")
def filter_in_list(e):
    return e.select("orders").column("o_orderkey").where("o_orderstatus", ["F", "P"])


@query("select n_name from nation where n_regionkey not in (0, 1)")
def filter_not_in_list(e):
    return e.select("nation").column("n_name").where("n_regionkey", [0, 1], "<>")


@query("select n_name from nation where n_nationkey < 5")
def filter_empty_list(e):
    q = e.select("nation").column("n_name")
    q.get_where().or_(lambda w: w.is_in("n_nationkey", []).is_less("n_nationkey", 5) and None).is_not_in("n_nationkey", [])
    return q


@query("select n_name from nation where n_regionkey in (2)")
def filter_in_scalar(e):
    return e.select("nation").column("n_name").where("n_regionkey", 2, "in")


@query("select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
def filter_in_subquery(e):
    return _customers(e).where("c_nationkey", e.select("nation").column("n_nationkey").where("n_regionkey", 1))


@query("select c_custkey from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)")
def filter_not_in_subquery(e):
    return _customers(e).where("c_nationkey", e.select("nation").column("n_nationkey").where("n_regionkey", 1), "<>")


@query("select c_custkey from customer where c_nationkey not in (select nullif(n_nationkey, 3) from nation)")
def filter_not_in_null(e):
    return _customers(e).where("c_nationkey", e.select("nation").column_expression("nullif(n_nationkey, 3)"), "not in")


@query("select c.c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 400000)")
def filter_exists(e):
    q = e.select("customer", "c").column("c.c_custkey")
    inner = e.select("orders", "o").column_expression("1").where("o.o_custkey", ColumnRef("c.c_custkey")).where("o.o_totalprice", 400000, ">")
    q.get_where().exists(inner)
    return q


@query("select c.c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')")
def filter_not_exists(e):
    q = e.select("customer", "c").column("c.c_custkey")
    inner = e.select("orders", "o").column_expression("1").where("o.o_custkey", ColumnRef("c.c_custkey")).where("o.o_orderpriority", "1-URGENT")
    q.get_where().not_exists(inner)
    return q


@query("select l_orderkey, l_linenumber from lineitem where l_quantity between 10 and 12")
def filter_between(e):
    return e.select("lineitem").column("l_orderkey").column("l_linenumber").where("l_quantity", [10, 12], "between")


@query("select p_partkey from part where p_size not between 5 and 45")
def filter_not_between(e):
    return e.select("part").column("p_partkey").where("p_size", [5, 45], "not between")


_NULLS = "select s.s_suppkey from supplier s left join nation n on n.n_nationkey = s.s_nationkey and n.n_regionkey = 2 where n.n_name is "


def _suppliers(e):
    q = e.select("supplier", "s").column("s.s_suppkey")
    q.left_join_where("nation", "n").is_equal("n.n_nationkey", ColumnRef("s.s_nationkey")).is_equal("n.n_regionkey", 2)
    return q


@query(_NULLS + "null")
def filter_is_null(e):
    return _suppliers(e).where("n.n_name", None, "is null")


@query(_NULLS + "not null")
def filter_is_not_null(e):
    return _suppliers(e).where("n.n_name", None, "is not null")


_P = "select p_partkey, p_name from part where p_name "


def _parts(e, add):
    q = e.select("part").column("p_partkey").column("p_name")
    add(q.get_where())
    return q


@query(_P + "like '%widget'")
def filter_like(e):
    return _parts(e, lambda w: w.is_like("p_name", "%?", "widget"))


@query("select n_name from nation where n_name like 'NATION\\_1%' escape '\\'")
def filter_like_escaped(e):
    q = e.select("nation").column("n_name")
    q.get_where().is_like("n_name", "?%", "NATION_1")
    return q


@query(_P + "not like '%widget'")
def filter_not_like(e):
    return _parts(e, lambda w: w.is_not_like("p_name", "%widget"))


@query("select p_partkey from part where p_type ilike 'eco%'")
def filter_ilike(e):
    q = e.select("part").column("p_partkey")
    q.get_where().is_like_insensitive("p_type", "?%", "eco")
    return q


@query(_P + "not ilike '%WIDGET'")
def filter_not_ilike(e):
    return _parts(e, lambda w: w.is_not_like_insensitive("p_name", "%#", "WIDGET", "#"))


@query("select o_orderkey from orders where (o_orderstatus='F' or (o_orderstatus='P' and o_totalprice > 200000)) and o_custkey between 1 and 100")
def filter_and_or_tree(e):
    q = e.select("orders").column("o_orderkey")
    w = q.get_where()
    w.open("or").is_equal("o_orderstatus", "F").open("and").is_equal("o_orderstatus", "P").is_greater("o_totalprice", 200000).close().close()
    w.is_between("o_custkey", 1, 100)
    return q


@query("select o_orderkey from orders where o_orderstatus = 'F' or o_totalprice > 400000")
def filter_where_or(e):
    return e.select("orders").column("o_orderkey").where_or(lambda w: w.is_equal("o_orderstatus", "F").is_greater("o_totalprice", 400000))


@query("select o_orderkey from orders where o_orderstatus = 'F' and o_totalprice > 400000")
def filter_where_and(e):
    return e.select("orders").column("o_orderkey").where_and(lambda w: w.is_equal("o_orderstatus", "F").is_greater("o_totalprice", 400000))


@query("select o_orderkey from orders where o_orderkey % 7 = 3 and (o_custkey = 5 or o_totalprice < 50000)")
def filter_raw(e):
    return e.select("orders").column("o_orderkey").where_expression("o_orderkey % ? = ?", [7, 3]).where_expression("(o_custkey = ? or o_totalprice < ?)", [5, 50000])


@query("select l_orderkey, l_linenumber from lineitem where l_tax > l_discount")
def filter_column_column(e):
    return e.select("lineitem").columns(["l_orderkey", "l_linenumber"]).where("l_tax", ColumnRef("l_discount"), ">")


@query("select s_suppkey from supplier where s_acctbal > (select avg(s_acctbal) from supplier)")
def filter_scalar_subquery(e):
    return e.select("supplier").column("s_suppkey").where("s_acctbal", e.select("supplier").column_expression("avg(s_acctbal)"), ">")


@query("select n_nationkey from nation where n_name is distinct from 'NATION_3'")
def filter_is_not(e):
    return e.select("nation").column("n_nationkey").where("n_name", "NATION_3", "is not")


@query("select n_name from nation where n_regionkey = 1 and n_nationkey = 6")
def filter_row_compare(e):
    return e.select("nation").column("n_name").where_expression("(cast(n_regionkey as bigint), cast(n_nationkey as bigint)) = ?", [Row([Value(1, "bigint"), Value(6, "bigint")])])


@query("select n_name from nation")
def filter_empty(e):
    q = e.select("nation").column("n_name")
    q.get_where().open("or").open("and").close().close()
    return q


@query("select n_name from nation where n_name = null")
def filter_eq_null(e):
    return e.select("nation").column("n_name").where("n_name", None)


# joins


@query("select o.o_orderkey, c.c_name from orders o join customer c on c.c_custkey = o.o_custkey")
def join_inner(e):
    return e.select("orders", "o").column("o.o_orderkey").column("c.c_name").inner_join("customer", "c.c_custkey = o.o_custkey", "c")


@query("select c.c_custkey, o.o_orderkey from customer c left join orders o on o.o_custkey = c.c_custkey and o.o_totalprice > 400000")
def join_left(e):
    return e.select("customer", "c").column("c.c_custkey").column("o.o_orderkey").left_join("orders", Raw("o.o_custkey = c.c_custkey and o.o_totalprice > ?", [400000]), "o")


@query("select n.n_name, s.s_name from supplier s right join nation n on n.n_nationkey = s.s_nationkey")
def join_right(e):
    return e.select("supplier", "s").column("n.n_name").column("s.s_name").join("nation", "n.n_nationkey = s.s_nationkey", "n", JoinMode.RIGHT)


@query("select * from (select n_nationkey as nk, n_name from nation) a natural join (select s_nationkey as nk, s_suppkey from supplier) b")
def join_natural(e):
    left = e.select("nation").column("n_nationkey", "nk").column("n_name")
    right = e.select("supplier").column("s_nationkey", "nk").column("s_suppkey")
    return e.select(left, "a").natural_join(right, "b")


@query("select a.r_name as x, b.r_name as y from region a cross join region b")
def join_no_condition(e):
    return e.select("region", "a").column("a.r_name", "x").column("b.r_name", "y").join("region", None, "b")


@query("select n.n_name, s.s_suppkey from nation n join supplier s on s.s_nationkey = n.n_nationkey and (s.s_acctbal > 0 or n.n_regionkey = 2)")
def join_where(e):
    q = e.select("nation", "n").column("n.n_name").column("s.s_suppkey")
    on = q.inner_join_where("supplier", "s").is_equal("s.s_nationkey", ColumnRef("n.n_nationkey"))
    on.or_(lambda w: w.is_greater("s.s_acctbal", 0).is_equal("n.n_regionkey", 2))
    return q


@query("select a.p_partkey as x, b.p_partkey as y from part a join part b on a.p_size < b.p_size and b.p_size <= a.p_size + 1 and a.p_brand = b.p_brand")
def join_theta(e):
    # Sizes are whole numbers, so the one size above a's and no further than 1 is a key to join by beside the brand; past the largest, try_add gives null and no pair.
    # Pairs outnumber parts by far: sorted and merged they are spread by key, where a broadcast leaves them to the one or two tasks that scan a small file.
    on = "b.p_size = try_add(a.p_size, 1) and a.p_size < b.p_size and b.p_size <= a.p_size + 1 and a.p_brand = b.p_brand"
    return e.select("part", "a").column("a.p_partkey", "x").column("b.p_partkey", "y").join("part", on, "b").hint("merge", "a", "b")


@query("select c.c_custkey, t.n from customer c join (select o_custkey, count(*) as n from orders group by o_custkey) t on t.o_custkey = c.c_custkey")
def join_derived(e):
    inner = e.select("orders").column("o_custkey").column_expression("count(*)", "n").group_by("o_custkey")
    return e.select("customer", "c").column("c.c_custkey").column("t.n").join(inner, "t.o_custkey = c.c_custkey", "t")


@query("select a.n_name as x, b.n_name as y from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def join_self(e):
    q = e.select("nation", "a").column("a.n_name", "x").column("b.n_name", "y")
    q.join_where("nation", "b").is_equal("a.n_regionkey", ColumnRef("b.n_regionkey")).is_less("a.n_nationkey", ColumnRef("b.n_nationkey"))
    return q


@query("select c.c_custkey, n.n_name, r.r_name from customer c join nation n on n.n_nationkey = c.c_nationkey join region r on r.r_regionkey = n.n_regionkey")
def join_multi(e):
    q = e.select("customer", "c").column("c.c_custkey").column("n.n_name").column("r.r_name")
    return q.join("nation", "n.n_nationkey = c.c_nationkey", "n").join("region", "r.r_regionkey = n.n_regionkey", "r")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def semi_join(e):
    return e.select("customer", "c").column("c.c_custkey").join("orders", "o.o_custkey = c.c_custkey and o.o_orderstatus = 'P'", "o", JoinMode.SEMI)


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def anti_join(e):
    return e.select("customer", "c").column("c.c_custkey").join("orders", "o.o_custkey = c.c_custkey and o.o_orderstatus = 'P'", "o", JoinMode.ANTI)


@query("select n.n_nationkey, s.s_suppkey from nation n full join supplier s on s.s_nationkey = n.n_nationkey and s.s_acctbal > 5000")
def join_full(e):
    return e.select("nation", "n").column("n.n_nationkey").column("s.s_suppkey").join("supplier", "s.s_nationkey = n.n_nationkey and s.s_acctbal > 5000", "s", JoinMode.FULL)


# aggregates


@query("select o_orderstatus, o_orderpriority, count(*) as n, min(o_totalprice) as lo, max(o_totalprice) as hi from orders group by o_orderstatus, o_orderpriority")
def group_by(e):
    q = e.select("orders").column("o_orderstatus").column("o_orderpriority")
    q.column_expression("count(*)", "n").column_expression("min(o_totalprice)", "lo").column_expression("max(o_totalprice)", "hi")
    return q.group_by("o_orderstatus").group_by("o_orderpriority")


@query("select l_returnflag, cast(sum(l_linenumber) as bigint) as s, round(avg(l_quantity), 6) as a, count(l_tax) as n from lineitem group by l_returnflag")
def agg_functions(e):
    q = e.select("lineitem").column("l_returnflag").column_expression("sum(l_linenumber)", "s").column_expression("round(avg(l_quantity), 6)", "a")
    return q.column_expression("count(l_tax)", "n").group_by("l_returnflag")


@query("select count(*) as n, max(l_quantity) as q from lineitem")
def agg_global(e):
    return e.select("lineitem").column_expression("count(*)", "n").column_expression("max(l_quantity)", "q")


@query("select l_returnflag, count(distinct l_suppkey) as n from lineitem group by l_returnflag")
def count_distinct(e):
    return e.select("lineitem").column("l_returnflag").column_expression("count(distinct l_suppkey)", "n").group_by("l_returnflag")


@query("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12 and o_custkey < 100")
def having_condition(e):
    q = e.select("orders").column("o_custkey").column_expression("count(*)", "n").group_by("o_custkey")
    return q.having(Raw("count(*)"), 12, ">").having("o_custkey", 100, "<")


@query("select o_custkey from orders group by o_custkey having sum(o_totalprice) > 1000000")
def having_expression(e):
    return e.select("orders").column("o_custkey").group_by("o_custkey").having_expression("sum(o_totalprice) > ?", [1000000])


@query("select o_custkey from orders group by o_custkey having count(*) > 14 or min(o_totalprice) < 1500")
def having_or(e):
    return e.select("orders").column("o_custkey").group_by("o_custkey").having_or(lambda w: w.expression("count(*) > ?", [14]).expression("min(o_totalprice) < ?", [1500]) and None)


@query("select o_custkey from orders group by o_custkey having count(*) > 5 and min(o_totalprice) < 20000")
def having_and(e):
    return e.select("orders").column("o_custkey").group_by("o_custkey").having_and(lambda w: w.expression("count(*) > ?", [5]).expression("min(o_totalprice) < ?", [20000]) and None)


@query("select count(*) as n from orders having count(*) > 10")
def having_global(e):
    return e.select("orders").column_expression("count(*)", "n").having_expression("count(*) > 10")


@query("select o_custkey from orders group by o_custkey order by count(*) desc, o_custkey asc limit 5")
def order_by_aggregate(e):
    return e.select("orders").column("o_custkey").group_by("o_custkey").order_by_expression("count(*)", Order.DESC).order_by("o_custkey").range(5)


@query("select n.*, count(c.c_custkey) as customers from nation n left join customer c on c.c_nationkey = n.n_nationkey group by n.n_nationkey, n.n_name, n.n_regionkey")
def group_by_functional_dep(e):
    e.store.constrain("nation", primary_key=("n_nationkey",))
    q = e.select("nation", "n").column("n.*").column_expression("count(c.c_custkey)", "customers")
    return q.left_join("customer", "c.c_nationkey = n.n_nationkey", "c").group_by("n.n_nationkey")


@query("select count(*) as count from orders where o_orderstatus = 'F'")
def count_query(e):
    return e.select("orders").column("o_orderkey").where("o_orderstatus", "F").order_by("o_orderkey").range(5, 2).count_query()


@query("select count(*) as groups from (select o_custkey from orders group by o_custkey having count(*) > 5)")
def count_query_grouped(e):
    return e.select("orders").column("o_custkey").group_by("o_custkey").having_expression("count(*) > 5").count_query("groups")


@query("select distinct o_orderstatus, o_orderpriority from orders")
def distinct(e):
    return e.select("orders").columns(["o_orderstatus", "o_orderpriority"]).distinct()


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup(o_orderstatus, o_orderpriority)")
def grouping_sets(e):
    q = e.select("orders").column("o_orderstatus").column("o_orderpriority").column_expression("count(*)", "n")
    return q.group_by_expression("rollup(o_orderstatus, o_orderpriority)")


@query("select o_custkey, count(*) filter (where o_orderstatus = 'F') as f from orders group by o_custkey")
def agg_filter(e):
    return e.select("orders").column("o_custkey").column_expression("count(*) filter (where o_orderstatus = ?)", "f", ["F"]).group_by("o_custkey")


# windows


@query("select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders")
def window_raw(e):
    return e.select("orders").column("o_orderkey").column_expression("cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint)", "rn")


@query("select event_id, lag(value) over (partition by user_id order by ts, event_id) as before, count(*) over (partition by user_id order by ts, event_id rows between 2 preceding and current row) as n from events")
def window_frame(e):
    q = e.select("events").column("event_id").column_expression("lag(value) over (partition by user_id order by ts, event_id)", "before")
    return q.column_expression("count(*) over (partition by user_id order by ts, event_id rows between 2 preceding and current row)", "n")


# order and range


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def order_by(e):
    return e.select("orders").columns(["o_orderkey", "o_totalprice"]).order_by("o_totalprice", Order.DESC).order_by("o_orderkey").range(20)


@query("select p_partkey from part order by case when p_size > 40 then 0 else 1 end, p_partkey limit 10")
def order_by_expression(e):
    return e.select("part").column("p_partkey").order_by_expression("case when p_size > ? then 0 else 1 end", arguments=[40]).order_by("p_partkey").range(10)


_ON = "select c.c_custkey, o.o_orderkey from customer c left join orders o on o.o_custkey=c.c_custkey and o.o_totalprice>400000 order by o.o_orderkey "


def _ordered(e, order, nulls):
    q = e.select("customer", "c").column("c.c_custkey").column("o.o_orderkey").left_join("orders", "o.o_custkey = c.c_custkey and o.o_totalprice > 400000", "o")
    return q.order_by("o.o_orderkey", order, nulls).order_by("c.c_custkey").range(10)


@query(_ON + "desc nulls first, c.c_custkey limit 10")
def order_nulls(e):
    return _ordered(e, Order.DESC, Nulls.FIRST)


@query(_ON + "asc nulls last, c.c_custkey limit 10")
def order_nulls_default_asc(e):
    return _ordered(e, Order.ASC, Nulls.DEFAULT)


@query(_ON + "desc nulls first, c.c_custkey limit 10")
def order_nulls_default_desc(e):
    return _ordered(e, Order.DESC, Nulls.DEFAULT)


@query("select p_partkey from part order by p_partkey limit 10 offset 3")
def limit_offset(e):
    return e.select("part").column("p_partkey").order_by("p_partkey").range(10, 3)


@query("select p_partkey from part order by p_partkey offset 100")
def offset_only(e):
    return e.select("part").column("p_partkey").order_by("p_partkey").range(0, 100)


@query("select p_partkey from part order by p_partkey limit 7 offset 14")
def page(e):
    return e.select("part").column("p_partkey").order_by("p_partkey").page(7, 3)


@query("""select p.p_partkey, (select count(*) from part) as total, cast(ceil((select count(*) from part) / 7.0) as bigint) as last_page
from (select p_partkey from part order by p_partkey limit 7 offset 14) p""")
def query_pager(e):
    pager = e.pager(e.select("part").column("p_partkey").order_by("p_partkey"), 7, 3)
    rows = e.select(Values([[r["p_partkey"]] for r in pager], ["p_partkey"]), "p").column_expression("cast(p.p_partkey as bigint)", "p_partkey")
    return rows.column_value(pager.total, "total", "bigint").column_value(pager.last_page, "last_page", "bigint")


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 25")
def top_k(e):
    q = e.select("lineitem").columns(["l_orderkey", "l_linenumber", "l_extendedprice"])
    return q.order_by("l_extendedprice", Order.DESC).order_by("l_orderkey").order_by("l_linenumber").range(25)


# sets and common tables


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def union(e):
    return e.select("customer").column("c_nationkey", "k").union(e.select("supplier").column("s_nationkey"))


@query("select n_name as v from nation union select r_name from region")
def union_create(e):
    q = e.select("nation").column("n_name", "v")
    q.create_union("region").column("r_name")
    return q


@query("select n_regionkey as k from nation union (select c_nationkey from customer union select s_nationkey from supplier)")
def union_nested(e):
    inner = e.select("customer").column("c_nationkey").union(e.select("supplier").column("s_nationkey"))
    return e.select("nation").column("n_regionkey", "k").union(inner)


@query("select n_nationkey as k, n_name as v from nation union select * from (values (0,'NATION_0'),(99,'X')) as t")
def union_values(e):
    return e.select("nation").column("n_nationkey", "k").column("n_name", "v").union(Values([[Value(0, "int"), "NATION_0"], [Value(99, "int"), "X"]]))


@query("(select n_nationkey as k from nation order by n_nationkey desc limit 3) union select r_regionkey from region")
def union_order_limit(e):
    return e.select("nation").column("n_nationkey", "k").order_by("n_nationkey", Order.DESC).range(3).union(e.select("region").column("r_regionkey"))


@query("select c_nationkey as k from customer union all select s_nationkey from supplier")
def union_all(e):
    return e.select("customer").column("c_nationkey", "k").union_all(e.select("supplier").column("s_nationkey"))


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def intersect(e):
    return e.select("customer").column("c_nationkey", "k").intersect(e.select("supplier").column("s_nationkey"))


@query("select n_nationkey as k from nation except select s_nationkey from supplier")
def except_(e):
    return e.select("nation").column("n_nationkey", "k").except_(e.select("supplier").column("s_nationkey"))


@query("""with big as (select * from orders where o_totalprice > 300000), per as (select o_custkey, count(*) as n from big group by o_custkey)
select n, count(*) as customers from per group by n""")
def cte(e):
    q = e.select("per").column("n").column_expression("count(*)", "customers").group_by("n")
    q.with_("big", e.select("orders").where("o_totalprice", 300000, ">"))
    q.create_with("per", "big").column("o_custkey").column_expression("count(*)", "n").group_by("o_custkey")
    return q


@query("with t(id,label) as (values (1,'a'),(2,'b')) select * from t")
def cte_values(e):
    return e.select("t").with_("t", Values([[Value(1, "int"), "a"], [Value(2, "int"), "b"]]).columns(["id", "label"]))


@query("with recursive t(n) as (select 1 union all select n + 1 from t where n < 10) select n from t")
def cte_recursive(e):
    step = e.select().column_value(1, "n", "int").union_all(e.select("t").column_expression("n + 1").where("n", 10, "<"))
    return e.select("t").column("n").with_("t", step, recursive=True, columns=["n"])


@query("""with regional as (select r.r_name as region, sum(o.o_totalprice) as total from orders o join customer c on c.c_custkey = o.o_custkey
join nation n on n.n_nationkey = c.c_nationkey join region r on r.r_regionkey = n.n_regionkey group by r.r_name),
top as (select region from regional where total > (select sum(total) / 10 from regional))
select r.r_name as region, o.o_orderpriority as product, count(*) as n from orders o join customer c on c.c_custkey = o.o_custkey
join nation n on n.n_nationkey = c.c_nationkey join region r on r.r_regionkey = n.n_regionkey where r.r_name in (select region from top)
group by r.r_name, o.o_orderpriority""")
def cte_regional_sales(e):
    def base():
        q = e.select("orders", "o").join("customer", "c.c_custkey = o.o_custkey", "c").join("nation", "n.n_nationkey = c.c_nationkey", "n")
        return q.join("region", "r.r_regionkey = n.n_regionkey", "r")

    q = base().column("r.r_name", "region").column("o.o_orderpriority", "product").column_expression("count(*)", "n").group_by("r.r_name").group_by("o.o_orderpriority")
    q.with_("regional", base().column("r.r_name", "region").column_expression("sum(o.o_totalprice)", "total").group_by("r.r_name"))
    q.create_with("top", "regional").column("region").where_expression("total > (select sum(total) / 10 from regional)")
    return q.where("r.r_name", e.select("top").column("region"))


# values inside


@query("select event_id, cast(json_extract_string(props,'$.k') as int) as k from events")
def json_field(e):
    return e.select("events").column("event_id").column_expression("cast(get_json_object(props, '$.k') as int)", "k")


@query("select event_id from events where ts >= timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-11 00:00:00'")
def time_filter(e):
    q = e.select("events").column("event_id").where_expression("ts >= ?::timestamp", ["2024-01-10 00:00:00"])
    return q.where_expression("ts < ?::timestamp", ["2024-01-11 00:00:00"])


@query("select n_name from nation where n_nationkey in (1, 3, 5)")
def array_argument(e):
    return e.select("nation").column("n_name").where_expression("array_contains(?, cast(n_nationkey as bigint))", [Value([1, 3, 5], "bigint[]")])


@query("select r_name, r_name || '-' || lower(r_name) as both, length(r_name) as n from region")
def string_functions(e):
    q = e.select("region").column("r_name").column_expression("r_name || ? || lower(r_name)", "both", ["-"])
    return q.column_expression("cast(length(r_name) as bigint)", "n")


@query("select r_name as \"a.b\" from region")
def identifier_with_dot(e):
    inner = e.select("region").column("r_name", "a.b")
    return e.select(inner, "t").column(Identifier("a.b"))


# changes: the table as it is afterwards


@query("select s_suppkey, s_name, case when s_acctbal < 0 then 0.0 else s_acctbal end as s_acctbal from supplier")
def update_where(e):
    e.update("supplier").set("s_acctbal", 0.0).where("s_acctbal", 0, "<").perform()
    return e.select("supplier").columns(["s_suppkey", "s_name", "s_acctbal"])


@query("select s.s_suppkey, case when n.n_regionkey = 1 then 'moved' else s.s_name end as s_name from supplier s left join nation n on n.n_nationkey = s.s_nationkey")
def update_join(e):
    e.update("supplier", "s").set("s_name", "moved").join("nation", "n.n_nationkey = s.s_nationkey", "n").where("n.n_regionkey", 1).perform()
    return e.select("supplier").columns(["s_suppkey", "s_name"])


@query("select r_regionkey, (select max(n_name) from nation where n_regionkey = r_regionkey) as r_name from region")
def update_set_subquery(e):
    inner = e.select("nation").column_expression("max(n_name)").where_expression("n_regionkey = region.r_regionkey")
    e.update("region").set("r_name", inner).perform()
    return e.select("region").columns(["r_regionkey", "r_name"])


@query("select p_partkey from part where not coalesce(p_size > 25, false)")
def delete_where(e):
    e.delete("part").where("p_size", 25, ">").perform()
    return e.select("part").column("p_partkey")


@query("select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'P')")
def delete_using(e):
    e.delete("customer", "c").join("orders", "o.o_custkey = c.c_custkey", "o").where("o.o_orderstatus", "P").perform()
    return e.select("customer").column("c_custkey")


@query("select r_regionkey, r_name from region union all values (10,'TEN'),(11,'ELEVEN')")
def insert_values(e):
    e.insert("region").values({"r_regionkey": 10, "r_name": "TEN"}).values([11, "ELEVEN"]).perform()
    return e.select("region").columns(["r_regionkey", "r_name"])


@query("select r_regionkey, r_name from region union all select n_nationkey + 100, upper(n_name) from nation where n_regionkey = 1")
def insert_select(e):
    rows = e.select("nation").column_expression("n_nationkey + 100").column_expression("upper(n_name)").where("n_regionkey", 1)
    e.insert("region").columns(["r_regionkey", "r_name"]).query(rows).perform()
    return e.select("region").columns(["r_regionkey", "r_name"])


@query("select n_nationkey, n_name from nation union all select * from (values (3,'dup'),(100,'new')) v(k,nm) where k not in (select n_nationkey from nation)")
def merge_ignore(e):
    e.store.constrain("nation", primary_key=("n_nationkey",))
    e.merge("nation").set_key("n_nationkey").on_conflict_ignore().columns(["n_nationkey", "n_name"]).query(Values([[3, "dup"], [100, "new"]])).perform()
    return e.select("nation").columns(["n_nationkey", "n_name"])


@query("select coalesce(v.k, n.n_nationkey) as n_nationkey, case when v.k is not null then v.nm else n.n_name end as n_name from nation n full join (values (3,'upd'),(100,'new')) v(k,nm) on v.k = n.n_nationkey")
def merge_update(e):
    e.store.constrain("nation", primary_key=("n_nationkey",))
    e.merge("nation").on_conflict_update("n_nationkey").columns(["n_nationkey", "n_name"]).values([3, "upd"]).values([100, "new"]).perform()
    return e.select("nation").columns(["n_nationkey", "n_name"])


@query("select s.s_suppkey, 'X' as s_name, n.n_name from supplier s join nation n on n.n_nationkey = s.s_nationkey where n.n_regionkey = 2")
def returning_update(e):
    q = e.update("supplier", "s").set("s_name", "X").join("nation", "n.n_nationkey = s.s_nationkey", "n").where("n.n_regionkey", 2)
    return q.returning("s.s_suppkey").returning("s.s_name").returning("n.n_name").execute().frame


@query("select p_partkey, p_size * 2 as twice from part where p_size > 40")
def returning_delete(e):
    return e.delete("part").where("p_size", 40, ">").returning("p_partkey").returning_expression("p_size * 2", "twice").execute().frame


@query("select * from (values (20, 'A'), (21, 'B')) t(r_regionkey, r_name)")
def returning_insert(e):
    return e.insert("region").columns(["r_regionkey", "r_name"]).values([20, "A"]).values([21, "B"]).returning().execute().frame


@query("select o_custkey, o_orderkey from orders where o_custkey = 7 order by o_orderkey")
def prepared(e):
    q = e.prepare(lambda b: b.select("orders").column("o_custkey").column("o_orderkey").where("o_custkey", 1).order_by("o_orderkey"))
    return q.execute([7]).frame


@query("select 5 as r_regionkey, 'kept' as r_name union all select * from region")
def transaction_rollback(e):
    with e.begin() as pending:
        e.insert("region").values({"r_regionkey": 5, "r_name": "kept"}).perform()
        point = pending.savepoint()
        e.delete("region").perform()
        point.rollback()
        pending.commit()
    return e.select("region")



# statistics and time windows


_STATISTICS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "pages": ["page_id", "url", "html"], "benchmark": ["item_id", "text"], "conversations": ["conv_id", "turn", "role", "text"],
}


def _sizes(columns: list[str]) -> list[str]:
    return [f"coalesce(sum(octet_length(encode(cast({c} as varchar)))), 0)" for c in columns]


@query(" union all ".join(f"select '{t}' as table_name, count(*) as row_count, {len(c)} as column_count, cast({' + '.join(_sizes(c))} as bigint) as size_bytes from {t}" for t, c in _STATISTICS.items()))
def table_statistics(e):
    """All tables but those with columns of fractions, whose texts differ between engines."""
    from quern.sources.schema import Introspector

    return Introspector(e.store).table_statistics(list(_STATISTICS))


@query(f"""with t as (select count(*) as n, {', '.join(f'cast({x} as bigint) as b{k}' for k, x in enumerate(_sizes(_STATISTICS["documents"])))},
{', '.join(f'count(*) - count({c}) as z{k}' for k, c in enumerate(_STATISTICS["documents"]))} from documents), u as (select *, b0 + b1 + b2 + b3 + b4 as total from t)
{' union all '.join(f"select '{c}' as column_name, b{k} as total_bytes, round(b{k} / n, 6) as average_bytes, round(b{k} * 100 / total, 6) as percent, z{k} as nulls from u" for k, c in enumerate(_STATISTICS["documents"]))}""")
def column_statistics(e):
    from quern.sources.schema import Introspector

    return Introspector(e.store).column_statistics("documents")


@query("""select time_bucket(interval '1 hour', ts) as window_start, time_bucket(interval '1 hour', ts) + interval '1 hour' as window_end,
event_type, count(*) as n, max(value) as top from events group by all""")
def window_tumbling(e):
    from quern.streaming.windows import windowed

    rows = e.select("events").frame()
    return windowed(rows, "ts", "1 hour", ["event_type"], {"n": "count(*)", "top": "max(value)"})


@query("""with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select min(ts) as window_start, max(ts) + interval '6 hours' as window_end, user_id, count(*) as n from s group by user_id, k""")
def window_session(e):
    from quern.streaming.windows import sessions

    return sessions(e.select("events").frame(), "ts", "6 hours", ["user_id"], {"n": "count(*)"})


from quern.plans import behaviours  # noqa: E402, F401  (registers more)
