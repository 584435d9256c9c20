"""Changes, constraints and transactions on stored tables."""

import os

import pytest

from quern.errors import (
    AmbiguousIdentifier, ForeignKeyViolation, NotNullViolation, QueryError, TableDoesNotExist, TransactionError, TransactionFailed, UniqueViolation,
)
from quern.plans.expressions import ColumnRef, Raw, Values
from quern.session import Engine
from tests.conftest import DATA


@pytest.fixture
def people(engine):
    s = engine.store
    s.create("users", {"id": "integer", "name": "varchar(255)"}, primary_key=["id"])
    s.create("users_status", {"id_user": "integer", "status": "integer"})
    s.create("some_table", {"id": "serial", "foo": "integer not null", "bar": "varchar(255)", "baz": "timestamp", "id_user": "integer"}, primary_key=["id"], defaults={"baz": "cast(current_timestamp() as timestamp_ntz)"})
    engine.insert("users").columns(["id", "name"]).values([1, "admin"]).values([2, "jean"]).perform()
    engine.insert("users_status").columns(["id_user", "status"]).values([1, 7]).values([2, 11]).values([2, 17]).perform()
    rows = [(42, "a", 1), (666, "b", 1), (37, "c", 2), (11, "d", 2), (27, "e", 1)]
    engine.insert("some_table").columns(["foo", "bar", "id_user"]).query(Values(rows)).perform()
    return engine


def foos(engine, **where):
    q = engine.select("some_table").column("foo").order_by("foo")
    for column, value in where.items():
        q.where(column, value)
    return q.execute().fetch_column()


def test_update_where(people):
    assert people.update("some_table").set("foo", 43).where("foo", 42).perform() == 1
    row = people.select("some_table").where("foo", 43).execute().fetch()
    assert row["bar"] == "a" and row.get("baz") is not None
    q = people.update("some_table").set("bar", "cassoulet")
    q.get_where().or_().is_equal("foo", 43).is_equal("foo", 666)
    assert q.perform() == 2


def test_update_join_and_returning(people):
    q = people.update("some_table", "t").set("foo", 127).join("users", "u.id = t.id_user", "u").where("u.name", "admin")
    found = q.copy().returning("*").execute()
    assert found.count_rows() == 3
    assert {(r["foo"], r["name"]) for r in found} == {(127, "admin")}
    assert foos(people, id_user=1) == [127] * 3 and foos(people, id_user=2) == [11, 37]


def test_update_in_query(people):
    inner = people.select("users").column("id").where("name", "admin")
    assert people.update("some_table").set("foo", 127).where("id_user", inner).perform() == 3


def test_update_from_columns(people):
    assert people.update("some_table", "t").set("foo", ColumnRef("u.id")).join("users", "u.id = t.id_user", "u").where("u.id", 1).perform() == 3
    assert foos(people, id_user=1) == [1, 1, 1]
    assert people.update("some_table", "t").set("foo", Raw("t.id_user * 2")).join("users", "u.id = t.id_user", "u").where("t.id_user", 2).perform() == 2
    assert foos(people, id_user=2) == [4, 4]


def test_update_rules(people):
    with pytest.raises(QueryError):
        people.update("some_table").perform()
    with pytest.raises(QueryError):
        people.update("some_table").set("nope", 1).perform()


def test_several_matches_count_once(people):
    q = people.update("some_table", "t").set("foo", 0).join("users_status", "s.id_user = t.id_user", "s").where("t.id_user", 2)
    assert q.perform() == 2


def test_delete(people):
    assert people.delete("some_table").where("id_user", 2).perform() == 2
    assert people.delete("some_table").where("bar", "a").perform() == 1
    assert people.select("some_table").execute().count_rows() == 2
    assert people.delete("some_table").perform() == 2


def test_delete_null_is_false(people):
    people.insert("some_table").values({"foo": 5, "id_user": None}).perform()
    assert people.delete("some_table").where("id_user", 1, "<>").perform() == 2
    assert len(foos(people)) == 4


def test_delete_using(people):
    q = people.delete("some_table", "t").join("users", "u.id = t.id_user", "u").where("u.id", 2)
    q.returning("t.id").returning("t.id_user").returning("u.name").returning("t.bar")
    assert {(r["id_user"], r["name"]) for r in q.execute()} == {(2, "jean")}
    many = lambda status: people.delete("some_table", "t").join("users", "u.id = t.id_user", "u").join("users_status", "s.id_user = u.id", "s").where("s.status", status)
    assert many(5).perform() == 0 and many(7).perform() == 3


def test_prepared(people):
    q = people.prepare(lambda b: b.select("some_table").column("foo").where("id_user", 0).order_by("bar", nulls=__import__("quern.plans.queries", fromlist=["Nulls"]).Nulls.LAST))
    assert q.execute([1]).fetch_column() == [42, 666, 27]
    assert q.execute([2]).fetch_column() == [37, 11]
    with pytest.raises(QueryError):
        q.execute([1, 2])
    with pytest.raises(QueryError):
        q.option("a", 1)
    name = people.prepare_query(people.select("users").where("id", 1))
    assert people.execute_prepared(name, [2]).fetch()["name"] == "jean"


def test_insert(people):
    nasty = "); delete from users; select ('\\"
    q = people.insert("some_table").columns(["foo", "bar"])
    for k in range(12):
        q.values([k, nasty if k == 7 else f"b{k}"])
    result = q.execute()
    assert result.count() == 0 and result.count_rows() == 12
    assert people.select("some_table").where("bar", nasty).execute().count_rows() == 1
    found = people.insert("some_table").columns(["foo", "bar"]).values([1, "boo"]).values([2, "baa"]).returning("id").returning("bar", "miaw").execute()
    assert [(r["id"], r["miaw"]) for r in found] == [(18, "boo"), (19, "baa")]
    people.insert("some_table").values({"foo": Raw("11 + 11"), "baz": Raw("cast(current_timestamp() as timestamp_ntz)")}).perform()
    assert 22 in foos(people)


def test_insert_defaults_and_select(people):
    people.store.create("d", {"a": "integer", "b": "varchar"}, defaults={"a": "5", "b": "'x'"})
    assert people.insert("d").perform() == 1
    assert people.select("d").execute().fetch().to_dict() == {"a": 5, "b": "x"}
    assert people.insert("d").query(people.select("users").column("id").column("name")).perform() == 2
    assert people.insert("d").with_("w", people.select("users").where("id", 2)).query(people.select("w").column("id").column("name")).perform() == 1
    people.insert("d").values({"a": 2.5}).perform()
    assert people.select("d").column("a").order_by("a").execute().fetch_column() == [1, 2, 2, 2, 5]


@pytest.fixture
def three(engine):
    s = engine.store
    s.create("table1", {"id": "int", "foo": "int not null", "fizz": "varchar(255)"}, primary_key=["id"])
    s.create("table2", {"id": "int", "bar": "int not null", "buzz": "varchar(255)"}, primary_key=["id"])
    engine.insert("table1").columns(["id", "foo", "fizz"]).values([1, 1, "a"]).values([2, 2, "b"]).values([3, 3, "c"]).perform()
    engine.insert("table2").columns(["id", "bar", "buzz"]).values([1, 1, "d"]).values([3, 3, "e"]).values([5, 5, "f"]).perform()
    return engine


def table1(engine):
    return [tuple(r.to_raw_dict().values()) for r in engine.select("table1").order_by("id").execute()]


def test_merge_ignore(three):
    rows = three.select("table2").columns(["id", "bar", "buzz"])
    three.merge("table1").columns(["id", "foo", "fizz"]).query(rows.copy().where("id", [1, 3])).on_conflict_ignore().perform()
    assert table1(three) == [(1, 1, "a"), (2, 2, "b"), (3, 3, "c")]
    assert three.merge("table1").columns(["id", "foo", "fizz"]).values([9, 9, "x"]).values([9, 8, "y"]).on_conflict_ignore().perform() == 1


def test_merge_update(three):
    rows = three.select("table2").columns(["id", "bar", "buzz"]).where("id", [1, 3, 5])
    assert three.merge("table1").set_key("id").columns(["id", "foo", "fizz"]).query(rows).on_conflict_update().perform() == 3
    assert table1(three) == [(1, 1, "d"), (2, 2, "b"), (3, 3, "e"), (5, 5, "f")]
    found = three.merge("table1").columns(["id", "foo", "fizz"]).values([3, 3, None]).values([7, 7, "h"]).on_conflict_update("id").returning().execute()
    assert sorted((r["id"], r["fizz"]) for r in found) == [(3, None), (7, "h")]
    assert (3, 3, None) in table1(three)


def test_merge_rules(three):
    q = three.merge("table1").columns(["id", "foo"]).values([1, 1])
    with pytest.raises(QueryError):
        q.perform()
    with pytest.raises(UniqueViolation):
        three.merge("table1").columns(["id", "foo"]).values([1, 1]).values([1, 2]).on_conflict_update("id").perform()


def test_constraint_errors(engine):
    s = engine.store
    s.create("one", {"foo": "int"}, primary_key=["foo"])
    s.create("two", {"foo": "int not null", "bar": "int"}, unique={"two_bar": ["bar"]}, foreign_keys={"two_foo": (["foo"], "one", ["foo"])})
    with pytest.raises(NotNullViolation):
        engine.insert("two").values({"bar": 1}).perform()
    with pytest.raises(ForeignKeyViolation):
        engine.insert("two").values({"foo": 1}).perform()
    engine.insert("one").values({"foo": 1}).perform()
    engine.insert("two").values({"foo": 1, "bar": 2}).perform()
    with pytest.raises(UniqueViolation):
        engine.insert("two").values({"foo": 1, "bar": 2}).perform()
    with pytest.raises(ForeignKeyViolation):
        engine.delete("one").perform()
    assert engine.select("two").execute().count_rows() == 1
    with pytest.raises(TableDoesNotExist):
        engine.select("nowhere_at_all").execute()
    with pytest.raises(TableDoesNotExist):
        engine.insert("nowhere_at_all").values({"a": 1}).perform()
    with pytest.raises(AmbiguousIdentifier):
        engine.select("one").from_("two").column("foo").execute()


@pytest.fixture
def ledger(engine):
    engine.store.create("ledger", {"id": "serial", "foo": "int not null", "bar": "varchar"}, unique={"u_foo": ["foo"], "u_bar": ["bar"]}, deferrable=["u_foo", "u_bar"])
    engine.insert("ledger").columns(["foo", "bar"]).values([1, "a"]).values([2, "b"]).values([3, "c"]).perform()
    return engine


def add(engine, foo, bar):
    engine.insert("ledger").values({"foo": foo, "bar": bar}).perform()


def size(engine):
    return engine.select("ledger").execute().count_rows()


def test_commit_and_rollback(ledger):
    t = ledger.begin()
    add(ledger, 4, "d")
    t.commit()
    assert size(ledger) == 4
    t = ledger.begin()
    add(ledger, 5, "e")
    t.rollback()
    assert size(ledger) == 4
    with pytest.raises(TransactionError):
        t.commit()
    add(ledger, 6, "f")
    assert ledger.select("ledger").column("id").where("foo", 6).execute().fetch_field() == 6


def test_nested(ledger):
    outer = ledger.begin()
    add(ledger, 4, "d")
    inner = ledger.begin()
    add(ledger, 5, "e")
    inner.rollback()
    outer.commit()
    assert size(ledger) == 4
    with pytest.raises(TransactionError):
        with ledger.begin():
            add(ledger, 9, "z")
    assert size(ledger) == 4


def test_savepoints(ledger):
    t = ledger.begin()
    ledger.update("ledger").set("bar", "z").where("foo", 1).perform()
    point = t.savepoint("here")
    with pytest.raises(TransactionError):
        t.savepoint("here")
    ledger.update("ledger").set("bar", "y").where("foo", 2).perform()
    point.rollback()
    t.commit()
    assert ledger.select("ledger").column("bar").order_by("foo").execute().fetch_column() == ["z", "b", "c"]


def test_deferral(ledger):
    t = ledger.begin().deferred().immediate("u_bar")
    add(ledger, 2, "d")
    with pytest.raises(UniqueViolation) as caught:
        add(ledger, 5, "b")
    assert caught.value.constraint == "u_bar"
    with pytest.raises(TransactionFailed):
        size(ledger)
    t.rollback()
    t = ledger.begin().deferred()
    add(ledger, 2, "d")
    with pytest.raises(UniqueViolation):
        t.commit()
    assert size(ledger) == 3


def test_run_transaction(ledger):
    assert ledger.run_transaction(lambda e: add(e, 8, "h") or 5) == 5
    with pytest.raises(ZeroDivisionError):
        ledger.run_transaction(lambda e: add(e, 9, "i") or 1 / 0)
    assert size(ledger) == 4 and ledger.transaction is None


# engines and files


def test_engines_know_their_own_tables(spark):
    small, large = (Engine.over(spark, DATA.replace("sf0.001", sf), ["customer", "nation"]) for sf in ("sf0.001", "sf0.01"))
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("customer")
    count = lambda e: e.execute("select count(*) from customer").fetch_field()
    try:
        a, b = count(small), count(large)
        assert a < b and count(small) == a
        assert large.delete("customer").where("c_custkey", 10, "<").perform() == 10
        assert (count(small), count(large)) == (a, b - 10)
        small.update("nation").set("n_name", "here").where("n_nationkey", 1).perform()
        assert "here" not in large.select("nation").column("n_name").execute().fetch_column()
        large.store.create("a.b", {"x": "int"})
        large.store.create("a__b", {"y": "int"})
        large.insert("a.b").values([1]).perform()
        assert large.select("a.b").execute().column_names() == ["x"] and large.select("a__b").execute().count_rows() == 0
        assert spark.table("customer").columns == ["a"]
        root = large.store.root
        for e in (small, large):
            e.store.close()
            assert {t.name for t in e.session.catalog.listTables() if t.isTemporary} <= {t.name for t in spark.catalog.listTables()}
        assert not os.path.exists(root.removeprefix("file:"))
    finally:
        spark.catalog.dropTempView("customer")


@pytest.fixture
def parts(engine, spark, tmp_path):
    """A table of four files, one with a blank in its path."""
    path = str(tmp_path / "some folder.parquet")
    spark.range(4000).selectExpr("id", "id % 7 as g", "cast(id as string) as t").repartitionByRange(4, "id").write.parquet(path)
    engine.store.declare("parts", path)
    engine.store.load("parts")
    engine.store.constrain("parts", primary_key=("id",))
    return engine


def test_changes_write_the_files_that_they_touch(parts):
    store = parts.store
    before = set(store.versions["parts"].files)
    assert len(before) == 4
    assert parts.update("parts").set("t", "new").where("id", 5).perform() == 1
    kept = before & set(store.versions["parts"].files)
    assert len(kept) == 3
    assert parts.delete("parts", "p").join(Values([[3990], [3991]], ["k"]), "v.k = p.id", "v").perform() == 2
    assert len(before & set(store.versions["parts"].files)) == 2
    assert parts.merge("parts").on_conflict_update("id").columns(["id", "t"]).values([1500, "m"]).values([9000, "n"]).perform() == 2
    assert len(before & set(store.versions["parts"].files)) == 1
    assert parts.insert("parts").values([9001, 1, "i"]).perform() == 1
    found = {r["id"]: (r["g"], r["t"]) for r in parts.select("parts").execute()}
    assert len(found) == 4000 and found[5] == (5, "new") and found[1500] == (1500 % 7, "m") and found[9000] == (None, "n") and 3990 not in found
    assert parts.update("parts").set("t", "none").where("id", -1).perform() == 0


def test_random_changes_are_evaluated_once(parts):
    q = parts.update("parts").set("t", Raw("'hit'")).where_expression("rand() < 0.3")
    touched = q.perform()
    assert touched == parts.select("parts").where("t", "hit").execute().count_rows() and 800 < touched < 1600
    found = parts.delete("parts").where_expression("rand() < 0.2").returning("id").execute().fetch_column()
    assert parts.select("parts").execute().count_rows() == 4000 - len(found) and parts.select("parts").where("id", found).execute().count_rows() == 0


def test_small_changes_do_not_shuffle_the_table(parts, monkeypatch):
    plans = []
    within = parts.store.within

    def seen(rows, keys):
        out = within(rows, keys)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(parts.store, "within", seen)
    parts.insert("parts").values([8000, 1, "x"]).perform()
    parts.update("parts").set("id", 8001).where("id", 8000).perform()
    with pytest.raises(UniqueViolation):
        parts.insert("parts").values([17, 1, "x"]).perform()
    assert len(plans) == 3
    for plan in plans:
        assert "BroadcastHashJoin" in plan and "ReadSchema: struct<id:bigint>" in plan
        above = plan.split("BroadcastExchange")[0]
        assert "Exchange" not in above


def test_columns_named_like_words_keep_the_one_pass_form(engine):
    engine.store.create("picks", {"id": "int", "selected": "boolean"})
    engine.insert("picks").columns(["id", "selected"]).values([1, True]).values([2, False]).perform()
    assert engine.update("picks").set("id", Raw("id + 10")).where("selected", True).perform() == 1
    assert sorted(engine.select("picks").column("id").execute().fetch_column()) == [2, 11]
