"""What builders accept, refuse and write."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.errors import QueryError
from quern.functions.types import Converter
from quern.plans.expressions import Between, ColumnRef, Identifier, Like, Raw, Row, Scope, TableRef, Value, Values
from quern.plans.fragments import MARK, bind_raw, like_escaped, split_raw
from quern.plans.queries import Delete, Insert, Merge, QueryBuilder, Select, Update
from quern.plans.where import Where

SCOPE = Scope(Converter())


def text(node):
    return " ".join(node.write(SCOPE).text.replace(MARK, "?").split())


@pytest.mark.parametrize(
    ("sql", "arguments", "expected", "values"),
    [
        ("a = ?", [1], "a = ?", (1,)),
        ("a = ?::bigint", ["7"], "a = cast(? as bigint)", (7,)),
        ("a = ?::date and b = ?", ["2024-01-02", "x"], "a = cast(? as date) and b = ?", None),
        ("a ?? b = ?", [1], "a ? b = ?", (1,)),
        ("a = '?' and b = \"?\" and c = ?", [2], "a = '?' and b = \"?\" and c = ?", (2,)),
        ("a::bigint = ?", [3], "a::bigint = ?", (3,)),
        ("a = $$it's ?$$", [], "a = 'it\\'s ?'", ()),
        ("a = ?", [ColumnRef("t.b")], "a = `t`.`b`", ()),
        ("a = :name", [], "a = :name", ()),
        ("'it''s ?' = ?", ["x"], "'it''s ?' = ?", ("x",)),
    ],
)
def test_placeholders(sql, arguments, expected, values):
    found = bind_raw(sql, arguments, SCOPE)
    assert found.text.replace(MARK, "?") == expected
    if values is not None:
        assert found.values == values


@pytest.mark.parametrize("arguments", [[], [1, 2]])
def test_placeholder_count(arguments):
    with pytest.raises(QueryError):
        bind_raw("a = ?", arguments, SCOPE)


@given(st.text(alphabet="?'a\"$ :", max_size=12))
def test_splitting_loses_nothing(sql):
    parts = split_raw(sql)
    assert all(p.text or p.placeholder for p in parts)


def test_references():
    assert text(ColumnRef("a.b.c")) == "`a`.`b.c`"
    assert text(ColumnRef(Identifier("a.b"))) == "`a.b`"
    assert text(ColumnRef("t.*")) == "`t`.*"
    assert TableRef("s.t").key == "s.t" and TableRef(Identifier("s.t")).schema is None
    assert text(ColumnRef("a`b")) == "`a``b`"


@pytest.mark.parametrize("bad", [None, ""])
def test_empty_expression(bad):
    with pytest.raises(QueryError, match="cannot be null or empty"):
        Select("t").column(bad)
    with pytest.raises(QueryError):
        Select("t").column_expression(bad)


def test_values_arity():
    with pytest.raises(QueryError):
        Values([[1, 2], [3]])
    assert Values([[1, 2]]).names == ["col1", "col2"]


def test_where_tree():
    w = Where().is_equal("a", 1)
    w.or_(lambda x: x.is_null("b").is_not_null("c") and None)
    assert text(w) == "(`a` = ?) and ((`b` is null) or (`c` is not null))"
    assert text(Where()) == "true" and not Where()
    nested = Where()
    nested.open("or").open().close().close()
    assert not nested and text(nested) == "true"
    assert text(Where("or").condition("a", [1, 2]).condition("b", [3], "<>")) == "(`a` in (?, ?)) or (`b` not in (?))"
    assert text(Where().is_in("a", [])) == "false" and text(Where().is_not_in("a", [])) == "true"
    assert text(Where().condition("a", 1, "in")) == "`a` in (?)"
    assert text(Where().condition("a", "x", "is not")) == "`a` is distinct from ?"
    assert text(Where().condition("a", "x", "!<")) == "`a` !< ?"
    assert text(Where().condition("a", "x", "!~")) == "not rlike(`a`, ?)"


@pytest.mark.parametrize("act", [lambda w: w.condition("a", 1, "is null"), lambda w: w.condition("a", [1], "between"), lambda w: w.condition("a", 1, " "), lambda w: w.close()])
def test_where_errors(act):
    with pytest.raises(QueryError):
        act(Where())


def test_like():
    assert Like("a", "%?%", "5%_\\").pattern == "%5\\%\\_\\\\%"
    with pytest.raises(QueryError):
        Like("a", "%", "value")
    assert like_escaped("a_b") == "a\\_b"
    assert text(Like("a", "x%", negated=True, insensitive=True)) == "`a` not ilike ?"
    assert text(Between(ColumnRef("a"), 1, 2, negated=True)) == "`a` not between ? and ?"


def test_aliases():
    q = Select("t", "x")
    with pytest.raises(QueryError):
        q.from_("u", "x")
    assert text(Select("t").join("t", "true")) == "select * from `t` as `t` inner join `t` as `quern_1` on true"
    assert "`quern_1`" in text(Select(Values([[1]])))


def test_join_condition_kinds():
    with pytest.raises(QueryError):
        Select("t").join("u", 5)
    assert text(Select("t").join("u", lambda w: w.is_equal("t.a", ColumnRef("u.a")) and None)).endswith("on `t`.`a` = `u`.`a`")


def test_columns_can_go():
    q = Select("t").column("a").column("b", "c")
    assert q.has_column("a") and q.has_column("c") and not q.has_column("b")
    q.remove_column("a")
    assert not q.has_column("a")
    assert text(q.remove_all_columns()) == "select * from `t` as `t`"
    assert text(Select("t").columns({"x": "a", 1: "b"})) == "select `a` as `x`, `b` from `t` as `t`"


def test_range():
    with pytest.raises(QueryError):
        Select("t").range(-1)
    with pytest.raises(QueryError):
        Select("t").page(5, 0)
    assert Select("t").page(7, 3).limits == (7, 14)


def test_copies_are_apart():
    q = Select("t").where("a", 1)
    other = q.copy().where("b", 2)
    assert "`b`" not in text(q) and "`b`" in text(other)


def test_callables():
    assert text(Select("t").column(lambda: "a").where("b", lambda: 3)) == "select `a` from `t` as `t` where `b` = ?"
    assert text(Select("t").column("len")) == "select `len` from `t` as `t`"
    q = Select("t")
    q.having(lambda w: w.expression("count(*) > 1") and None)
    assert "having count(*) > 1" in text(q)


def test_write_rules():
    with pytest.raises(QueryError):
        Insert("t").columns(["a"]).columns(["b"])
    with pytest.raises(QueryError):
        Insert("t").values([1]).query(Select("u"))
    with pytest.raises(QueryError):
        Insert("t").query(Select("u")).values([1])
    with pytest.raises(QueryError):
        Update("t").set("t.a", 1)
    with pytest.raises(QueryError):
        Merge("t").set_key(["a.b"])
    with pytest.raises(QueryError):
        Merge("t").on_conflict("replace")
    copied = Insert("t").values({"a": 1}).copy()
    assert copied.names == ["a"]
    assert Delete("t").returning("a").returns_rows and not Delete("t").returns_rows


def test_no_engine():
    with pytest.raises(QueryError):
        QueryBuilder().select("t").execute()


def test_rows_and_values():
    assert text(Row([1, "a"])) == "struct(?, ?)"
    assert text(Value([1, 2], "int[]")) == "cast(array(?, ?) as array<int>)"
    assert text(Raw("f(?)", [Row([1, 2])])) == "f(struct(?, ?))"
    assert text(Select("t").group_by("a").column_expression("count(*)", "n").having(Raw("count(*)"), 2, ">").order_by("a")) == (
        "select count(*) as `n` from `t` as `t` group by `a` having count(*) > ? order by `a` asc nulls last"
    )


def test_hints():
    query = Select("a", "x y").join("b", "b.k = `x y`.k", "b").hint("merge", "x y", "b").hint("rebalance")
    assert text(query).startswith("select /*+ merge(`x y`, `b`), rebalance */ * from")
    assert text(Select("a").column("k").hint("rebalance").distinct()) == "select /*+ rebalance */ distinct `k` from `a` as `a`"
    with pytest.raises(QueryError):
        query.hint("merge(b) */ 1 --")
