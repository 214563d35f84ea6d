"""The user-defined function surface: scalar, aggregate, window and table functions, and batch operators."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.operators import relational

from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle


@R.add("udf_scalar_batch", "SELECT n_nationkey, upper(n_name) || '!' AS loud FROM nation")
def scalar(t):
    @F.pandas_udf("string")
    def loud(s: pd.Series) -> pd.Series:
        return s.str.upper() + "!"

    return t.nation.select("n_nationkey", loud("n_name").alias("loud"))


@R.add("udf_scalar_arrow", "SELECT n_nationkey, length(n_name)::BIGINT AS n FROM nation")
def arrow(t):
    @F.arrow_udf("long")
    def length(s: pa.Array) -> pa.Array:
        return pc.utf8_length(s).cast(pa.int64())

    return t.nation.select("n_nationkey", length("n_name").alias("n"))


def _spread():
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return spread


@R.add("udaf_grouped", "SELECT n_regionkey, (max(n_nationkey) - min(n_nationkey))::DOUBLE AS spread FROM nation GROUP BY 1")
def aggregate(t):
    return t.nation.groupBy("n_regionkey").agg(_spread()("n_nationkey").alias("spread"))


@R.add("udaf_window", "SELECT n_nationkey, (max(n_nationkey) OVER (PARTITION BY n_regionkey) - min(n_nationkey) OVER (PARTITION BY n_regionkey))::DOUBLE AS spread FROM nation")
def windowed(t):
    return t.nation.select("n_nationkey", _spread()("n_nationkey").over(Window.partitionBy("n_regionkey")).alias("spread"))


@R.add("udtf_table_function", "SELECT n_nationkey, i::INTEGER AS i FROM nation, (SELECT unnest([0, 1, 2]) AS i) WHERE i < n_nationkey % 3 + 1")
def table_function(t):
    @F.udtf(returnType="i: int")
    class Count:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    rows = t.nation.select("n_nationkey", (F.col("n_nationkey") % 3 + 1).alias("n"))
    return rows.lateralJoin(Count(F.col("n").outer())).select("n_nationkey", "i")


@R.add("bit_days_or", "SELECT n_regionkey, bit_or(n_nationkey::BIGINT) AS days FROM nation GROUP BY 1")
def bit_days_or(t):
    """Day bitmaps united word by word, aligned at the last word; here each has one word."""
    words = t.nation.select("n_regionkey", F.posexplode(F.array(F.col("n_nationkey").cast("long"))).alias("pos", "word"))
    united = words.groupBy("n_regionkey", "pos").agg(F.bit_or("word").alias("word"))
    return united.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w")).select("n_regionkey", F.get("w", F.lit(0))["word"].alias("days"))


def _consumed(rows):
    """Rows that a function consumed, called with batches on the executors."""

    def consume(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    return rows.select("o_orderkey").mapInArrow(consume, "n long").agg(F.sum("n").alias("n"))


@R.add("callback_sink", "SELECT count(*) AS n FROM orders")
def callback(t):
    return _consumed(t.orders)


@R.add("model_operator", "SELECT o_orderkey, round(1 / (1 + exp(-(o_totalprice / 100000 - 1))), 6) AS score FROM orders")
def model(t):
    """A model loaded once in each task and run on batches."""

    def load():
        import numpy as np

        weight, bias = np.array(1e-5), np.array(-1.0)
        return lambda price: 1 / (1 + np.exp(-(price * weight + bias)))

    return relational.model_operator(t.orders.select("o_orderkey", "o_totalprice"), load, ["o_totalprice"], "score").select("o_orderkey", F.round("score", 6).alias("score"))
