"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from lumenframe import plans
from lumenframe.plans.registry import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in found), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, duck):
    df = plans.QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name not in plans.ORACLE_SQL:
        assert got
        return
    cursor = duck.execute(plans.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, cursor.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
