"""fn_math on quantities and discounts that the tables lack: the SQL's rows, null, zero, negative and not-a-number ones too."""

import math

import duckdb

from lumenframe import plans


def test_math_of_odd_numbers_is_the_sqls(spark, tmp_path):
    nan, inf = math.nan, math.inf
    quantities, discounts = [None, nan, inf, -17.0, -10.0, -1.0, 0.0, 0.5, 1.0, 49.5, 50.0, 50.5, 70.0], [None, nan, -1.5, -1.0, -0.5, 0.05, 1.0, 1.5]
    rows = [(i, 1, q, d, 900.5) for i, (q, d) in enumerate((q, d) for q in quantities for d in discounts)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    cursor = con.execute(plans.ORACLE_SQL["fn_math"])
    names = [c[0] for c in cursor.description]
    want = {r[0]: dict(zip(names, r, strict=True)) for r in cursor.fetchall()}
    got = {r.id: r.asDict() for r in plans.QUERIES["fn_math"](spark, str(tmp_path)).collect()}
    plain = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else x
    assert got.keys() == want.keys()
    assert not [(rows[i // 10], k, got[i][k], v) for i, w in want.items() for k, v in w.items() if plain(got[i][k]) != plain(v)]
