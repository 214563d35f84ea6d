"""Aggregations whose result for a group is an array, a map, a sketch or a sample, in two steps.

The first step aggregates by the group's keys and the value's own (a map's key,
an array's place, a distinct value), with partial aggregation before its shuffle;
the second gathers one entry for each. So a group of any number of rows costs what
its result holds, and a hot group is combined where its rows are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOW = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max, "any": F.any_value}


def _gathered(rows: DataFrame, keys: list[str], key: str, value: Column, name: str) -> DataFrame:
    out = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), value))))
    return rows.groupBy(*keys).agg(out.alias(name))


def map_aggregate(df: DataFrame, keys: list[str], column: str, how: str, name: str) -> DataFrame:
    """The union of a group's maps, each key's values combined: sum, avg, count, min, max, or any of them. Null and empty maps add nothing."""
    rows = df.select(*keys, F.explode_outer(column).alias("_k", "_v"))
    each = rows.groupBy(*keys, "_k").agg(HOW[how]("_v").alias("_v"))
    # a group of empty maps alone is kept, as an empty map
    entries = F.filter(F.collect_list(F.struct("_k", "_v")), lambda e: e["_k"].isNotNull())
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(entries)).alias(name))


def histogram(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """How often each value that is not null occurs in a group."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    return _gathered(counts, keys, column, F.col("_n"), name)


def multimap(df: DataFrame, keys: list[str], key: str, value: str, name: str) -> DataFrame:
    """Each key's values in a group, in order."""
    lists = df.groupBy(*keys, key).agg(F.array_sort(F.collect_list(value)).alias("_l"))
    return _gathered(lists, keys, key, F.col("_l"), name)


def map_agg(df: DataFrame, keys: list[str], key: str, value: str, name: str) -> DataFrame:
    """A value of each key in a group: the least, where it has several."""
    one = df.filter(F.col(key).isNotNull()).groupBy(*keys, key).agg(F.min(value).alias("_v"))
    return _gathered(one, keys, key, F.col("_v"), name)


def distinct_values(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """A group's different values in order, null among them."""
    return df.select(*keys, column).distinct().groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(column))), lambda s: s[column]).alias(name))


def set_union(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """The different elements of a group's arrays, in order."""
    return distinct_values(df.select(*keys, F.explode(column).alias(name)), keys, name, name)


def extremes(df: DataFrame, keys: list[str], column: str, n: int, name: str, greatest: bool = True) -> DataFrame:
    """A group's n greatest (or least) values, in that order. Only n rows of a group leave each task (WindowGroupLimit)."""
    order = F.desc(column) if greatest else F.asc(column)
    rows = df.filter(F.col(column).isNotNull()).select(*keys, column).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_r") <= n)
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", column))), lambda s: s[column]).alias(name))


def array_aggregate(df: DataFrame, keys: list[str], column: str, how: str, name: str) -> DataFrame:
    """A group's arrays combined place by place: sum or count of the elements that are not null."""
    rows = df.select(*keys, F.posexplode(column).alias("_p", "_x")).groupBy(*keys, "_p").agg(HOW[how]("_x").alias("_v"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda s: s["_v"]).alias(name))


def reduce_agg(df: DataFrame, keys: list[str], column: str, start: Column, merge, name: str, chunk: int = 10_000) -> DataFrame:
    """A group's values folded by an associative merge with a neutral start, in chunks and then the chunks' results.

    Rows are dealt to chunks of about ``chunk`` rows, so no array holds more than that however large the group.
    """
    sizes = df.filter(F.col(column).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = df.filter(F.col(column).isNotNull()).join(sizes, keys).select(*keys, column, (F.xxhash64(F.monotonically_increasing_id()) % F.ceil(F.col("_n") / chunk)).alias("_c"))
    fold = lambda x: F.aggregate(F.collect_list(x), start, merge)
    return rows.groupBy(*keys, "_c").agg(fold(column).alias("_v")).groupBy(*keys).agg(fold("_v").alias(name))


def weighted_sample(df: DataFrame, weight: str, k: int, adjusted: str, seed: int = 0) -> DataFrame:
    """k rows with probability by weight (priority sampling), and weights adjusted so that sums of them are unbiased.

    A top-n: each task sends k + 1 rows, and k + 1 rows reach the last one.
    """
    rows = df.filter(F.col(weight) > 0).withColumn("_q", F.col(weight) / (1 - F.rand(seed))).orderBy(F.desc("_q")).limit(k + 1)
    rows = rows.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_q"))))
    least = F.max(F.when(F.col("_r") == k + 1, F.col("_q"))).over(Window.partitionBy())
    return rows.withColumn("_t", F.coalesce(least, F.lit(0.0))).filter(F.col("_r") <= k).withColumn(adjusted, F.greatest(F.col(weight), "_t")).drop("_q", "_r", "_t")


def bloom_filter(df: DataFrame, column: str, items: int | None = None, bits: int | None = None, rate: float = 0.03) -> bytes:
    """A Bloom filter over longs, merged from the executors' parts and serialised. Null is no member.

    Its size is set by items, not by rows; without items, by the number of different values. That is
    counted to 1 %, and 5 % more are allowed for, so that the rate holds for any table; at least 10,000.
    """
    spark = df.sparkSession
    longs = df.select(F.col(column).cast("long").alias(column)).filter(F.col(column).isNotNull())
    none = longs.isEmpty()
    if items is None:
        items = max(10_000, 0 if none else math.ceil(1.05 * longs.agg(F.approx_count_distinct(column, 0.01)).first()[0]))
    size = bits or math.ceil(-items * math.log(rate) / math.log(2) ** 2)
    if none:
        made = spark._jvm.org.apache.spark.util.sketch.BloomFilter.create(items, size)
    else:
        # Spark cuts items and bits to these limits without a word: raised while the filter is made
        limits = {f"spark.sql.optimizer.runtime.bloomFilter.maxNum{k}": v for k, v in (("Items", items), ("Bits", size))}
        before = {k: spark.conf.get(k, None) for k in limits}
        try:
            for k, v in limits.items():
                spark.conf.set(k, str(max(v, int(spark.conf.get(k)))))
            made = longs._jdf.stat().bloomFilter(column, items, size)
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark._jvm.java.io.ByteArrayOutputStream()
    made.writeTo(out)
    return bytes(out.toByteArray())
