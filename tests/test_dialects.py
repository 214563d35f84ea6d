"""Functions called by name, against values that their definitions fix, and their errors."""

import hashlib
import hmac
from decimal import Context, Decimal

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import udfs
from lumenframe.functions.dialects import function
from lumenframe.operators import aggregates as agg
from lumenframe.operators import relational as op


def one(spark, make, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(make().alias("r")).first().r


#: Published values of SpookyHash V2 (fixed values).
SPOOKY = {"": "232706FC6BF50919", "hello": "3768826AD382E6CA", "       ": "8A63CCE34DB3FC9E", "special_#@,$|%/^~?{}+-": "AAF4B42DDC33E6F0", "1234567890": "D9426F48C5CD219B", "more_than_12_characters_string": "3493AE21B95F627C"}


def test_spooky_hash():
    assert {t: f"{udfs.spooky(t.encode()):016X}" for t in SPOOKY} == SPOOKY
    # texts around the border between the short and the long form, and copies that differ in one byte
    texts = [bytes(n) for n in (95, 96, 191, 192, 193, 287, 288, 1000)] + [bytes(999) + b"x"]
    assert len({udfs.spooky(t) for t in texts}) == len(texts)


def test_bases(spark):
    p = lambda n, *a: function(n, "presto")(*a)
    cases = {("12", 10): 12, ("+12", 10): 12, ("-12", 10): -12, ("1a", 16): 26, ("11", 2): 3, ("1z", 36): 71, ("1" * 63, 2): 2**63 - 1, ("-ff", 16): -255}
    for (text, radix), want in cases.items():
        assert one(spark, lambda t=text, r=radix: p("from_base", F.lit(t), r)) == want
    for text, radix in (("0x12", 16), ("", 10), (" 12", 16), ("123xy", 10), ("9223372036854775808", 10), ("1" * 70, 2)):
        with pytest.raises(Exception, match="Not a valid|out of range"):
            one(spark, lambda t=text, r=radix: p("from_base", F.lit(t), r))
    for radix in (1, 37):
        with pytest.raises(ValueError, match="Radix must be between 2 and 36"):
            p("from_base", F.lit("0"), radix)
    assert one(spark, lambda: p("to_base", F.lit(-255).cast("bigint"), 16)) == "-ff" and one(spark, lambda: p("to_base", F.lit(-(2**63)).cast("bigint"), 16)) == "-8000000000000000"
    with pytest.raises(Exception, match="subscripts start at 1"):
        one(spark, lambda: p("subscript", F.array(F.lit(1)), F.lit(-1)))
    with pytest.raises(ValueError, match="not supported"):
        p("date_format", F.current_timestamp(), "%U")
    with pytest.raises(Exception, match="more than one element"):
        one(spark, lambda: p("element", F.array(F.lit(1), F.lit(2))))


def test_hashes_of_bytes(spark):
    p = lambda n, *a: function(n, "presto")(*a)
    for text, key in (("hashme", "key"), ("", "key"), ("x" * 300, "k" * 300)):
        assert bytes(one(spark, lambda t=text, k=key: p("hmac_sha512", F.lit(t), F.lit(k)))) == hmac.new(key.encode(), text.encode(), "sha512").digest()
        assert bytes(one(spark, lambda t=text: p("sha512", F.lit(t)))) == hashlib.sha512(text.encode()).digest()
    assert one(spark, lambda: function("hive_hash")(F.lit("hello"))) == 99162322
    assert one(spark, lambda: function("hive_hash")(F.lit(True), F.lit(2), F.lit(2**40).cast("bigint"))) == (31 * (31 * 1 + 2) + (2**40 >> 32)) % 2**32


def test_decimals_keep_their_digits(spark):
    a, b, exact = Decimal("12345678901234567890123456.7890123456"), Decimal("2.0000000001"), Context(prec=60)
    make = lambda name, left, right: lambda: function(name)(F.lit(a), F.lit(b), left, right)
    assert one(spark, make("add_deny_precision_loss", (38, 10), (38, 10))) == exact.add(a, b)
    assert one(spark, make("subtract_deny_precision_loss", (38, 10), (38, 10))) == exact.subtract(a, b)
    assert one(spark, make("multiply_deny_precision_loss", (38, 10), (38, 10))) is None
    assert one(spark, lambda: function("divide_deny_precision_loss")(F.lit(1), F.lit(0), (10, 0), (10, 0))) is None
    assert udfs.decimal_type("+", (38, 10), (38, 10), False) == (38, 10) and udfs.decimal_type("+", (38, 10), (38, 10), True) == (38, 9)
    # the lossy types are Spark's own
    for sign, (p1, s1), (p2, s2) in (("+", (38, 10), (38, 7)), ("*", (38, 10), (20, 5)), ("/", (38, 10), (20, 5)), ("*", (12, 2), (10, 0)), ("/", (12, 2), (10, 0)), ("-", (5, 5), (38, 0))):
        kind = spark.sql(f"SELECT typeof(CAST(1 AS DECIMAL({p1}, {s1})) {sign} CAST(1 AS DECIMAL({p2}, {s2}))) AS t" if s1 < p1 else f"SELECT typeof(CAST(0 AS DECIMAL({p1}, {s1})) {sign} CAST(1 AS DECIMAL({p2}, {s2}))) AS t").first().t
        assert kind == "decimal({},{})".format(*udfs.decimal_type(sign, (p1, s1), (p2, s2), True))


def test_aggregations_of_collections(spark):
    rows = spark.createDataFrame([(1, {"a": 1, "b": 2}, 5), (1, {"a": 3}, 5), (1, None, None), (2, {}, 7), (3, None, 1)], "k int, m map<string, long>, x int")
    got = {r.k: r.u for r in agg.map_aggregate(rows, ["k"], "m", "sum", "u").collect()}
    assert got == {1: {"a": 4, "b": 2}, 2: {}, 3: {}}
    assert {r.k: r.h for r in agg.histogram(rows, ["k"], "x", "h").collect()} == {1: {5: 2}, 2: {7: 1}, 3: {1: 1}}
    assert {r.k: r.s for r in agg.distinct_values(rows, ["k"], "x", "s").collect()} == {1: [None, 5], 2: [7], 3: [1]}
    assert agg.weighted_sample(rows.filter("x > 0"), "x", 10, "w").agg(F.sum("w")).first()[0] == 18
    assert agg.extremes(rows.limit(0), ["k"], "x", 2, "t").count() == 0


def test_not_in_and_column_frames(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    some, none, empty = (spark.createDataFrame(r, "b int") for r in ([(1,)], [(1,), (None,)], []))
    keep = lambda right: sorted((r.a for r in op.null_aware_anti_join(left, right, "a", "b").collect()), key=str)
    assert keep(some) == [2] and keep(none) == [] and keep(empty) == [1, 2, None]
    rows = spark.createDataFrame([(None, 1, 10, 0), (None, 2, 20, 1), ("k", 1, 1, 5), ("k", 2, 2, 0), ("k", 3, 4, 1)], "g string, o int, v int, back int")
    got = {(r.g, r.o): r.s for r in op.sum_since(rows, ["g"], "o", "v", F.col("back"), "s").collect()}
    assert got == {(None, 1): 10, (None, 2): 30, ("k", 1): 1, ("k", 2): 2, ("k", 3): 6}


def test_sorted_input_is_streamed(spark, tmp_path):
    from lumenframe import plans

    spark.range(100).selectExpr("id % 7 AS l_orderkey", "CAST(id AS DOUBLE) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = plans.QUERIES["agg_streaming_sorted"](spark, str(tmp_path))
    assert df.count() == 7
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "HashAggregate" not in plan


def test_asof_in_stretches_gives_what_one_window_gives(spark):
    import random

    rnd = random.Random(4)
    left = spark.createDataFrame([(rnd.choice([1, 2, None]), float(rnd.randrange(300)), i) for i in range(120)], "k int, t double, i int")
    right = spark.createDataFrame([(rnd.choice([1, 2, None]), float(x), f"v{x}") for x in rnd.sample(range(300), 60)], "k int, t double, v string")
    for keys in (["k"], []):
        l, r = (left, right) if keys else (left.drop("k"), right.drop("k"))
        whole = sorted(map(tuple, op.asof_join(l, r, keys, "t", ["v"]).collect()), key=str)
        assert sorted(map(tuple, op.asof_join(l, r, keys, "t", ["v"], span=25.0).collect()), key=str) == whole
