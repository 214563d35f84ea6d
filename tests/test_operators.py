"""Operators and functions on small inputs, edge cases included."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.functions.dialects import function, mysql_pattern
from lumenframe.operators import relational as op
from lumenframe.sources import merge


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_mark_join_is_three_valued(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(1,), (None,)], "b int")
    got = {r.a: r.m for r in op.mark_join(left, right, "a", "b", "m", null_aware=True).collect()}
    assert got == {1: True, 2: None, None: None}
    assert {r.m for r in op.mark_join(left, right.limit(0), "a", "b", "m", null_aware=True).collect()} == {False}


def test_enforce_single_row(spark):
    rows = spark.createDataFrame([(1,), (2,)], "a int")
    assert op.enforce_single_row(rows.limit(1)).first().a == 1
    assert op.enforce_single_row(rows.limit(0)).first().a is None
    with pytest.raises(Exception, match="single row"):
        op.enforce_single_row(rows).collect()


def test_asof_join_takes_ties_and_keeps_unmatched(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 3, "y")], "k string, t int, v string")
    assert {(r.k, r.t): r.v for r in op.asof_join(left, right, ["k"], "t", ["v"]).collect()} == {("a", 5): "x", ("a", 1): None, ("b", 9): None}


def test_unnest_ordinality(spark):
    rows = spark.createDataFrame([(1, [7, 8], ["x"])], "id int, a array<int>, b array<string>")
    assert [tuple(r) for r in op.unnest(rows, ["id"], {"a": "a", "b": "b"}, "n").collect()] == [(1, 7, "x", 1), (1, 8, None, 2)]


def test_merge_engines(spark):
    rows = spark.createDataFrame([(1, 1, "a", 5), (1, 2, None, 6), (2, 1, "z", None)], "k int, s int, v string, w int")
    assert {tuple(r) for r in merge.partial_update(rows, ["k"], "s").collect()} == {(1, 2, "a", 6), (2, 1, "z", None)}
    assert {tuple(r) for r in merge.deduplicate(rows, ["k"], "s").collect()} == {(1, 2, None, 6), (2, 1, "z", None)}
    assert {tuple(r) for r in merge.first_row(rows, ["k"], "s").collect()} == {(1, 1, "a", 5), (2, 1, "z", None)}
    got = merge.aggregation(rows, ["k"], "s", {"v": "listagg", "w": "sum"}).collect()
    assert {tuple(r) for r in got} == {(1, 2, "a", 11), (2, 1, "z", None)}


def test_seeded_hashes_agree_with_built_ins(spark):
    d = spark.createDataFrame([("",), ("abc",), ("überlang und mehr",)], "s string")
    for r in d.select(F.hash("s").alias("a"), function("hash_with_seed")(42, F.col("s")).alias("b"), F.xxhash64("s").alias("c"), function("xxhash64_with_seed")(42, F.col("s")).alias("d")).collect():
        assert r.a == r.b and r.c == r.d


def test_distributions(spark):
    p = lambda n, *a: one(spark, function(n, "presto")(*a))
    assert abs(p("normal_cdf", 0.0, 1.0, 1.96) - 0.9750021) < 1e-6
    assert abs(p("binomial_cdf", 10.0, 0.5, 5.0) - 0.623046875) < 1e-9
    assert abs(p("chi_squared_cdf", 2.0, 2.0) - 0.6321205588) < 1e-9
    assert abs(p("inverse_normal_cdf", 0.0, 1.0, 0.975) - 1.959963985) < 1e-6


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3)), max_size=8))
def test_array_functions(spark, values):
    a = F.lit(None).cast("array<int>") if values is None else F.array(*[F.lit(v).cast("int") for v in values]) if values else F.array().cast("array<int>")
    got = spark.range(1).select(function("array_frequency", "presto")(a).alias("f"), function("array_has_duplicates", "presto")(a).alias("h")).first()
    real = [v for v in values if v is not None]
    assert got.f == {v: real.count(v) for v in set(real)}
    assert got.h == (len(set(values)) < len(values))


def test_mysql_pattern():
    assert mysql_pattern("%Y-%m-%d T %i%%") == "yyyy-MM-dd 'T' mm%"
