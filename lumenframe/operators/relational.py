"""Relational operators that the DataFrame API has no single method for.

Each is a composition of built-in operators, so Catalyst plans it; none collects
rows or runs Python on them, apart from ``python_operator``, whose work is that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Bytes below which lookup_join broadcasts its table.
LOOKUP_BYTES = 64 << 20


def _plan_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a table's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def mark_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, mark: str, null_aware: bool = False) -> DataFrame:
    """left with a column that says whether its key is in right; unknown (null) follows SQL's IN where null_aware."""
    keys = right.select(F.col(right_key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    joined = left.join(keys, F.col(left_key) == F.col("_k"), "left").drop("_k")
    found = F.coalesce("_hit", F.lit(False))
    if null_aware:
        # one row of two booleans, whatever the table's size
        about = right.agg(F.coalesce(F.bool_or(F.col(right_key).isNull()), F.lit(False)).alias("_nulls"), (F.count("*") > 0).alias("_rows"))
        joined = joined.crossJoin(F.broadcast(about))
        found = F.when(F.col("_hit"), True).when(F.col("_rows") & (F.col("_nulls") | F.col(left_key).isNull()), None).otherwise(False)
    return joined.withColumn(mark, found).select(*left.columns, mark)


def null_aware_anti_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """The rows that SQL's NOT IN keeps: none where right has a null key, none with a null key unless right is empty.

    A shuffled join on the keys and one row of two booleans: right is not broadcast, whatever its size.
    """
    mark = "_in"
    return mark_join(left, right, left_key, right_key, mark, null_aware=True).filter(~F.col(mark)).drop(mark)


def sum_since(df: DataFrame, keys: list[str], order: str, value: str, before: Column, name: str) -> DataFrame:
    """For each row, the sum of value over it and as many rows of its keys before it as a column says.

    A frame whose bounds are columns: running sums, and a join with the running sum
    of the row before the frame, so that work is linear in the rows and not in the frames.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_i", F.row_number().over(w)).withColumn("_s", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("_j", F.col("_i") - before - 1)
    ends = rows.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col("_i").alias("_end"), F.col("_s").alias("_until"))
    same = F.col("_j") == F.col("_end")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    met = rows.join(ends, same, "left")
    return met.select(*df.columns, (F.col("_s") - F.coalesce("_until", F.lit(0))).alias(name))


def lookup_join(probe: DataFrame, table: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join with a lookup table: broadcast if its estimated size allows, shuffled otherwise."""
    return probe.join(F.broadcast(table) if _plan_bytes(table) <= LOOKUP_BYTES else table, on, how)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], order: str, values: list[str], span: float | None = None) -> DataFrame:
    """left with the values of the last right row of the same keys at or before it.

    Both sides are stacked and carried forward in one window: one shuffle by the
    keys, and memory for one row, where a range join would emit all earlier pairs.
    With a span (in the order's units, seconds for times), rows of one key are dealt
    over stretches of that length, each carried forward by itself; what a stretch
    starts with comes from the last values of those before it. So a key that holds
    a large part of the rows, or no key at all, is many tasks.
    """
    carried = F.struct(*values)
    rows = left.select(*keys, order, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(carried.alias("s")).schema["s"].dataType).alias("_value"))
    rows = rows.unionByName(right.select(*keys, order, F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), carried.alias("_value")))
    out = lambda seen: seen.filter("_side = 1").select("_row.*", *(F.col(f"_value.{v}").alias(v) for v in values))
    if span is None:
        w = Window.partitionBy(*keys).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return out(rows.withColumn("_value", F.last("_value", ignorenulls=True).over(w)))
    kind = dict(rows.dtypes)[order]
    at = F.col(order).cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else F.col(order).cast("double")
    rows = rows.withColumn("_part", F.floor(at / span))
    w = Window.partitionBy(*keys, "_part").orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.withColumn("_here", F.last("_value", ignorenulls=True).over(w))
    # one row for each key and stretch
    last = rows.groupBy(*keys, "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_k{i}" for i in range(len(keys))]
    start = last.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("_part").alias("_of"), F.last("_last", ignorenulls=True).over(before).alias("_before"))
    same = F.col("_part") == F.col("_of")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return out(within.filter("_side = 1").join(start, same, "left").withColumn("_value", F.coalesce("_here", "_before")))


def range_join(points: DataFrame, spans: DataFrame, x: str, lo: str, hi: str, width: float) -> DataFrame:
    """Pairs with lo <= x < hi. Both sides meet in bins of the given width, an equi-join instead of all pairs."""
    bin_of = lambda c: F.floor(c / F.lit(width))
    binned = spans.filter(F.col(lo) < F.col(hi)).withColumn("_bin", F.explode(F.sequence(bin_of(F.col(lo)), bin_of(F.col(hi)))))
    return points.withColumn("_bin", bin_of(F.col(x))).join(binned, "_bin").filter((F.col(x) >= F.col(lo)) & (F.col(x) < F.col(hi))).drop("_bin")


def group_id(df: DataFrame, keys: list[str], sets: list[list[str]], inputs: list[str], name: str = "group_id") -> DataFrame:
    """Each row once for each grouping set, with absent keys null and the set's number; equal sets stay apart."""
    types = dict(df.dtypes)
    each = [F.struct(*((F.col(k) if k in s else F.lit(None).cast(types[k])).alias(k) for k in keys), *inputs, F.lit(i).alias(name)) for i, s in enumerate(sets)]
    return df.select(F.explode(F.array(*each)).alias("_g")).select("_g.*")


def expand(df: DataFrame, projections: list[list[Column]], names: list[str]) -> DataFrame:
    """Each row once for each projection."""
    each = [F.struct(*(c.alias(n) for c, n in zip(p, names, strict=True))) for p in projections]
    return df.select(F.explode(F.array(*each)).alias("_e")).select("_e.*")


def mark_distinct(df: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """df with a column that is true for one row of each distinct key."""
    return df.withColumn(mark, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))) == 1)


def row_number(df: DataFrame, keys: list[str], name: str, limit: int | None = None) -> DataFrame:
    """Rows numbered within keys in no set order, up to a limit."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
    return out if limit is None else out.filter(F.col(name) <= limit)


def top_n_row_number(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str) -> DataFrame:
    """The first n rows of each key; Catalyst limits groups before the shuffle (WindowGroupLimit)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def unnest(df: DataFrame, keep: list[str], arrays: dict[str, str], ordinality: str | None = None, start: int = 1, outer: bool = False) -> DataFrame:
    """Arrays zipped into rows, shorter ones padded with nulls; ordinality counts from start."""
    zipped = F.arrays_zip(*arrays)
    explode = F.posexplode_outer if outer else F.posexplode
    rows = df.select(*keep, explode(zipped).alias("_pos", "_z"))
    out = [F.col(f"_z.{a}").alias(n) for a, n in arrays.items()]
    return rows.select(*keep, *out, *([(F.col("_pos") + start).alias(ordinality)] if ordinality else []))


def enforce_single_row(df: DataFrame) -> DataFrame:
    """The only row of df; nulls if it has none, an error if it has more."""
    row = df.limit(2).agg(F.collect_list(F.struct(*df.columns)).alias("_rows"))
    one = F.when(F.size("_rows") > 1, F.raise_error(F.lit("expected a single row"))).otherwise(F.get("_rows", F.lit(0)))
    return row.select(one.cast(row.schema["_rows"].dataType.elementType).alias("_r")).select("_r.*")


def assign_unique_id(df: DataFrame, name: str) -> DataFrame:
    """A long that no other row has; values depend on the partitions."""
    return df.withColumn(name, F.monotonically_increasing_id())


def with_sorted_aggregation(spark):
    """A session whose aggregations stream over input that is sorted by their keys, instead of hashing it."""
    other = spark.newSession()
    other.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")
    return other


def model_operator(df: DataFrame, load: Callable[[], Callable], inputs: list[str], output: str, kind: str = "double") -> DataFrame:
    """df with what a model makes of its columns, a batch at a time.

    load is called once in each task and returns a function from arrays (NumPy) to
    one array: a module of any library that the workers have, or an ONNX session.
    """
    taken = df.columns

    def run(batches):
        model = load()
        for b in batches:
            made = model(*(b.column(c).to_numpy(zero_copy_only=False) for c in inputs))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in taken), pa.array(made)], names=[*taken, output])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(output, DataType.fromDDL(kind))]))


def trace(df: DataFrame, path: str) -> DataFrame:
    """Records the rows that an operator reads: df itself, from the written copy."""
    df.write.mode("overwrite").parquet(path)
    return trace_scan(df.sparkSession, path, df.schema)


def trace_scan(spark, path: str, schema=None) -> DataFrame:
    """Replays recorded rows."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def python_operator(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A Python function over Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(f, batches)

    return df.mapInPandas(run, schema)
