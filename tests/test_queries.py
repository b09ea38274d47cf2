"""Every registered query of the dialect against its SQL in DuckDB."""

import os

import duckdb
import pytest

from docquery import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else None if v is None else str(v)
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_matches_duckdb(spark, duck, name):
    df = q.queries()[name](spark, SF)
    cur = duck.execute(q.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cur.fetchall())


def test_flagship_pushes_down(spark):
    plan = q.queries()["flagship"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert "c_mktsegment" not in plan and "TakeOrderedAndProject" in plan


def test_order_is_observable(spark):
    got = [tuple(r) for r in q.queries()["order_position"](spark, SF).collect()]
    assert [r[1] for r in got] == sorted((r[1] for r in got), reverse=True)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
