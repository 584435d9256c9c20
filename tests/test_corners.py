"""Corners that are easily got wrong."""

import pytest

from quern.errors import QueryError, TransactionError
from quern.functions.types import Converter
from quern.plans.expressions import ColumnRef, Raw, Values
from quern.plans.queries import Delete, Insert, JoinMode, Merge, Select
from quern.sources.schema import Introspector
from quern.transactions import Isolation
from tests.test_builders import text


def test_first_column_is_found():
    q = Select("t").column("a")
    assert q.has_column("a") and not q.remove_column("a").has_column("a")
    d = Delete("t").returning("a", "x")
    assert d.returns_rows and not d.remove_returning("x").returns_rows


def test_builders_chain():
    assert isinstance(Merge("t").set_using_alias("u"), Merge)
    assert Merge("t").values({"a": 1}).copy().names == ["a"] and Insert("t").values([1]).copy().get_query().rows


def test_numbers_in_text():
    c = Converter()
    assert c.from_sql("-5", "int") == -5 and c.from_sql("1.5e2", "double") == 150.0 and c.to_sql(True, "bool") is True
    assert c.to_sql(["a,b", 'c"d'], "varchar[]") == ["a,b", 'c"d'] and c.to_sql([1, [2]], "row") == '(1,"(2)")'


def test_having_with_a_callback():
    q = Select("t")
    q.having(lambda w: w.is_greater(Raw("count(*)"), 1) and None)
    assert text(q).endswith("having count(*) > ?")


def test_recursive_is_written():
    assert text(Select("r").with_("r", Raw("select 1"), recursive=True)).startswith("with recursive `r` as (select 1)")


def test_range_of_a_union_member():
    q = Select("t").order_by("a").range(3).union(Select("u"))
    assert text(q).startswith("(select * from `t` as `t` order by `a` asc nulls last limit 3) union (select")


def test_outer_join_without_condition(engine):
    engine.store.create("few", {"a": "int"})
    engine.insert("few").values([1]).perform()
    assert engine.select("few", "x").join("few", None, "y", JoinMode.LEFT).column("x.a").execute().fetch_column() == [1]
    with pytest.raises(QueryError):
        engine.delete("few", "x").join("few", "true", "y", JoinMode.LEFT).perform()


def test_isolation_is_kept(engine):
    t = engine.create_transaction(Isolation.SERIALIZABLE)
    assert t.level is Isolation.SERIALIZABLE
    with pytest.raises(TransactionError):
        t.commit()
    t.start()
    with pytest.raises(TransactionError):
        t.start()
    with pytest.raises(TransactionError):
        engine.create_transaction().start()
    t.rollback()


def test_grouped_count_counts_groups(engine):
    engine.store.create("few", {"a": "int"})
    engine.insert("few").query(Values([[1], [1], [2]])).perform()
    assert engine.select("few").column("a").group_by("a").count_query().execute().fetch_field() == 2
    assert engine.select("few").count_query("n").execute().fetch()["n"] == 3


def test_reverse_keys(engine):
    engine.store.create("parent", {"id": "int"}, primary_key=["id"])
    engine.store.create("child", {"id": "int"}, foreign_keys={"up": (["id"], "parent", ["id"])})
    known = Introspector(engine.store)
    assert [k.table for k in known.table("parent").reverse_foreign_keys] == ["child"] and known.table("child").foreign_keys[0].target == "parent"
    assert known.column_statistics("parent").count() == 1


def test_closing(engine):
    engine.store.create("few", {"a": "int"})
    engine.insert("few").values([1]).perform()
    engine.store.close()
    assert engine.tables() == []


def test_raw_correlated(engine):
    for name in ("outside", "inside"):
        engine.store.create(name, {"a": "int"})
    engine.insert("outside").query(Values([[1], [2]])).perform()
    engine.insert("inside").values([2]).perform()
    q = engine.select("outside", "t").where_expression("exists (select 1 from inside b where b.a = t.a)")
    assert q.execute().fetch_column() == [2]
    inner = engine.select("inside", "b").column_expression("count(*)").where("b.a", ColumnRef("t.a"))
    assert engine.select("outside", "t").column_expression(inner, "n").order_by("t.a").execute().fetch_column() == [0, 1]
