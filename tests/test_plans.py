"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from loomgrid import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if x is None or isinstance(x, float | np.floating) and math.isnan(x):
            return "null"
        if isinstance(x, float | np.floating):
            return f"{x:.9g}"
        return "[" + ",".join(map(cell, x)) + "]" if isinstance(x, list | tuple | np.ndarray) else str(x)

    return sorted("|".join(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_agrees_with_sql(spark, con, small, name):
    got = plans.QUERIES[name](spark, small)
    want = con.sql(plans.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got.columns, got.collect()) == canon(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, small, name):
    """Without SQL: two runs agree, whatever the partitioning; event_stream_state is held against plain Python below."""
    one, two = (plans.QUERIES[name](spark, small) for _ in range(2))
    assert one.columns and canon(one.columns, one.collect()) == canon(two.columns, two.collect())


def test_streaks(spark, small):
    rows = spark.read.parquet(f"{small}/events.parquet").orderBy("ts", "event_id").collect()
    run, want = {}, []
    for r in rows:
        run[r.user_id] = run.get(r.user_id, 0) + 1 if r.event_type == "error" else 0
        if run[r.user_id] == 3:
            want.append((r.user_id, 3))
    assert sorted(map(tuple, plans.QUERIES["event_stream_state"](spark, small).collect())) == sorted(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert plans.QUERIES.keys() <= e.queries().keys() and plans.ORACLE.keys() <= e.oracle_sql().keys()
    assert e.oracle_sql().keys() <= e.queries().keys()
