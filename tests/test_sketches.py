"""Sketches and Bloom filters keep their size and error on tables of any size."""

import re
import struct

from pyspark.sql import functions as F

from lumenframe import plans
from lumenframe.functions import udfs
from lumenframe.operators import aggregates as agg

LINES = "l_returnflag string, l_partkey long, l_quantity double, l_linenumber int"


def lines(spark, folder, rows):
    spark.createDataFrame(rows, LINES).write.parquet(f"{folder}/lineitem.parquet")
    return plans.QUERIES["agg_sketches"](spark, str(folder))


def test_sketches_are_kept_for_flags_not_for_each_key_of_a_flag(spark, tmp_path):
    df = lines(spark, tmp_path, [("A", i, float(i % 50), i % 7) for i in range(100)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    keys = [re.search(r"keys=\[(.*?)\]", x).group(1) for x in plan.splitlines() if "keys=[" in x and "hll_sketch_agg" in x]
    assert keys and all(k.startswith("l_returnflag#") and "," not in k for k in keys)


def test_sketches_of_a_null_flag_and_of_null_keys(spark, tmp_path):
    rows = [(f, i if f != "N" else None, float(i % 50), i % 7) for f in ("A", None, "N") for i in range(3000)]
    got = {r[0]: tuple(r[1:]) for r in lines(spark, tmp_path, rows).collect()}
    assert got == {f: (True,) * 7 for f in ("A", None, "N")}


def test_bloom_filter_keeps_its_rate_whatever_the_number_of_orders(spark, tmp_path):
    spark.range(900_000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    assert tuple(plans.QUERIES["agg_bloom_filter"](spark, str(tmp_path)).first()) == (450_000, 0, True)


def test_bloom_filter_of_no_orders(spark, tmp_path):
    spark.createDataFrame([], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert tuple(plans.QUERIES["agg_bloom_filter"](spark, str(tmp_path)).first()) == (0, 0, True)


def test_bloom_filter_is_not_cut_to_the_session_limits(spark):
    key = "spark.sql.optimizer.runtime.bloomFilter.maxNumBits"
    spark.conf.set(key, "8192")
    try:
        bits = agg.bloom_filter(spark.range(50_000), "id")
        assert spark.conf.get(key) == "8192"
    finally:
        spark.conf.unset(key)
    assert 8 * len(bits) > 50_000 * 7


def test_might_contain_is_sparks_answer_for_both_versions(spark):
    """Negative, large and null values; a version 1 filter is the same bits by other steps, put together here."""
    values = [0, 1, -1, 2**63 - 1, -(2**63), 2**32, -(2**32) - 7, *(i * 7919 * 10**10 for i in range(-500, 500))]
    members, others = spark.createDataFrame([(v,) for v in values], "id long"), spark.range(5, 3005).select(F.xxhash64("id").alias("id"))
    bits = agg.bloom_filter(members, "id", 1000)
    own = spark._jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(spark._jvm.java.io.ByteArrayInputStream(bytearray(bits)))
    rows = members.union(others).union(spark.createDataFrame([(None,)], "id long")).select("id", udfs.might_contain(bits, F.col("id")).alias("hit")).collect()
    assert rows[-1].hit is None and [r.hit for r in rows[:-1]] == [own.mightContainLong(r.id) for r in rows[:-1]]

    hashes, words, first = struct.unpack(">i", bits[4:8])[0], 128, [0] * 128
    wrap = lambda x: (x + 2**31) % 2**32 - 2**31
    for v in values:
        data = (v % 2**64).to_bytes(8, "little")
        a = wrap(udfs._murmur3(data, 0))
        b = wrap(udfs._murmur3(data, a % 2**32))
        for i in range(1, hashes + 1):
            h = wrap(a + i * b)
            h = (~h if h < 0 else h) % (64 * words)
            first[h >> 6] |= 1 << (h & 63)
    old = struct.pack(f">iii{words}Q", 1, hashes, words, *first)
    assert all(r.hit for r in members.select(udfs.might_contain(old, F.col("id")).alias("hit")).collect())
    assert others.filter(udfs.might_contain(old, F.col("id"))).count() < 600
