"""Every query with SQL gives what DuckDB gives, on the smallest tables; the others give rows."""

import os
from decimal import Decimal

import duckdb
import pytest

from sparkloom.plans.catalogue import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, Decimal):
        return float(v)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    got = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(rows, df.columns) == table(got.fetchall(), columns)
