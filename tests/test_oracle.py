"""Every registered query of the engine that has SQL gives what DuckDB gives."""

import datetime
import decimal

import duckdb
import numpy as np
import pytest

from sluice import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def norm(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(norm, v))
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
    if name not in queries.SQL:
        assert got
        return
    found = duck.sql(queries.SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = [tuple(norm(r[i]) for i in at) for r in found.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_eval_math_to_the_last_digit(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select * replace (event_id * 8 as user_id) from '{SF}/events.parquet') to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.sql(queries.SQL["eval_math"])
    got = queries.QUERIES["eval_math"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
