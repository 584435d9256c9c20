"""Every registered query against its SQL on the smallest tables."""

import math
import re

import duckdb
import pandas as pd
import pytest

from quern.plans import catalogue
from tests.conftest import DATA


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in catalogue.TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return connection


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return f"{value:.9g}"
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_rows(spark, oracle, name):
    frame = catalogue.QUERIES[name](catalogue.engine(spark, DATA))
    found = oracle.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(names)
    order = [names.index(c) for c in sorted(names)]
    mine = sorted([plain(r[frame.columns.index(c)]) for c in sorted(names)] for r in frame.collect())
    assert mine == sorted([plain(r[k]) for k in order] for r in found.fetchall())


def test_ordered_queries_keep_order(spark, oracle):
    for name in ("flagship", "order_by", "order_nulls", "order_nulls_default_asc", "order_nulls_default_desc", "limit_offset", "page", "top_k"):
        mine = [tuple(map(plain, r)) for r in catalogue.QUERIES[name](catalogue.engine(spark, DATA)).collect()]
        assert mine == [tuple(map(plain, r)) for r in oracle.execute(catalogue.ORACLE_SQL[name]).fetchall()], name


def test_plans_push_down_and_prune(spark):
    engine = catalogue.engine(spark, DATA)
    plan = catalogue.QUERIES["filter_cmp"](engine)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size), GreaterThanOrEqual(p_size,10)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan
    product = catalogue.QUERIES["multi_from"](engine)._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in product and "Cartesian" not in product
    assert "TakeOrderedAndProject" in catalogue.QUERIES["top_k"](engine)._jdf.queryExecution().executedPlan().toString()


def test_theta_join_has_size_as_key(spark, tmp_path):
    sizes = [None, -1, 0, 1, 1, 2, 2, 4, 5, -(2**31), -(2**31) + 1, 2**31 - 2, 2**31 - 1, 2**31 - 1]
    parts = [(k, brand, size) for k, (brand, size) in enumerate((b, s) for b in ("A", "B", None) for s in sizes)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    frame = catalogue.QUERIES["join_theta"](catalogue.Engine.over(spark, str(tmp_path), ["part"]))
    linked = [(x, y) for x, b, s in parts for y, c, t in parts if None not in (b, s, t) and b == c and s < t <= s + 1]
    assert len(linked) == 2 * 11 and sorted(map(tuple, frame.collect())) == sorted(linked)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    keys = re.search(r"SortMergeJoin \[(.*?)\], \[(.*?)\], Inner", plan)
    assert keys and all("p_size" in k and "p_brand" in k for k in keys.groups()), plan
