"""Registered queries against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

from gazetteer import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def normal(v):
    return ("nan" if math.isnan(v) else repr(v)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(registry.oracle_sql()[name])
    order = [c[0] for c in found.description]
    assert sorted(order) == columns
    want = sorted(tuple(normal(r[order.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["reverse_geocode_top10", "house_match", "hierarchy_parent"])
def test_spatial_plans_have_no_nested_loops(spark, name):
    plan = registry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
