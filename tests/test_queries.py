"""Each query against its SQL, on the smallest tables."""

import math

import pytest

from placelens.plans import catalog


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return repr(round(float(v), 6)) if isinstance(v, int | float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() >= 0


def test_trips_are_all_orders(spark, sf, duck):
    want = dict(duck.sql("select l_orderkey, count(*) from lineitem group by 1").fetchall())
    for name in ("nearest_neighbour_route", "trip_schedule"):
        got = catalog.QUERIES[name](spark, sf).groupBy("trip_id").count().collect()
        assert {r["trip_id"]: r["count"] for r in got} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
