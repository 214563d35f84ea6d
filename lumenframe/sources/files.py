"""File sources and sinks with the options of the reference formats."""

from __future__ import annotations

from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "csv", "text", "json")


def read(spark: SparkSession, path: str, form: str = "parquet", schema: StructType | str | None = None, by_position: bool = False, metadata: bool = False, **options: Any) -> DataFrame:
    """A table of files. With a schema, columns that a file lacks are null; ``by_position`` renames the file's columns in order.

    Column pruning and filters reach Parquet and ORC scans; ``metadata`` adds the
    file's path, as synthesised columns do.
    """
    if form not in FORMATS:
        raise ValueError(f"unknown format {form}; one of {', '.join(FORMATS)}")
    if form == "csv":
        options = {"nullValue": r"\N", "sep": "\x01"} | options
    reader = spark.read.format(form).options(**options)
    if schema is not None and not by_position:
        reader = reader.schema(schema)
    df = reader.load(path)
    if schema is not None and by_position:
        wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        found = df.columns
        df = df.select(*((df[f"`{found[i]}`"] if i < len(found) else F.lit(None)).cast(f.dataType).alias(f.name) for i, f in enumerate(wanted.fields)))
    return df.select("*", F.col("_metadata.file_path").alias("$path")) if metadata else df


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, sort_by: list[str] | None = None, **options: Any) -> None:
    """Writes files, partitioned by values and sorted within; Spark's commit protocol makes retries safe."""
    if form == "csv":
        options = {"nullValue": r"\N", "sep": "\x01"} | options
    if partition_by:
        # rows of one partition value would else be spread over files of every task; AQE splits values that are large
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*(partition_by or []), *sort_by)
    writer = df.write.format(form).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, by: list[str], sort_by: list[str] | None = None, mode: str = "overwrite", path: str | None = None) -> None:
    """A bucketed table: later joins on its bucket columns need no shuffle."""
    # rows of one bucket in one task: a file for each bucket, not for each task and bucket
    writer = df.repartition(buckets, *by).write.mode(mode).bucketBy(buckets, *by)
    if path:
        writer = writer.option("path", path)
    (writer.sortBy(*sort_by) if sort_by else writer).saveAsTable(table)


class Written(NamedTuple):
    """What a write reports: its files with rows and bytes, and each column's rows, nulls and bounds."""

    fragments: DataFrame
    columns: DataFrame


def write_with_statistics(df: DataFrame, path: str, **options: Any) -> Written:
    """Writes Parquet files and reports them. Column statistics are gathered by the writing tasks and merged, without another pass."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    seen = Observation()
    each = [m for i, c in enumerate(plain) for m in (F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}"), F.min(f"`{c}`").cast("string").alias(f"l{i}"), F.max(f"`{c}`").cast("string").alias(f"g{i}"))]
    write(df.observe(seen, F.count("*").alias("rows"), *each), path, **options)
    got, spark = seen.get, df.sparkSession
    rows = [(c, got["rows"], got[f"n{i}"], got[f"l{i}"], got[f"g{i}"]) for i, c in enumerate(plain)]
    files = spark.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
    return Written(files, spark.createDataFrame(rows, "name string, rows long, nulls long, least string, greatest string"))


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def _random(kind: T.DataType, nulls: float, path: list[Column]) -> Column:
    """A value of any type that follows from a row's number and the value's place: the same on each run."""
    bits = F.xxhash64(*path)
    unit = F.pmod(bits, F.lit(1 << 40)) / float(1 << 40)
    below = lambda n: F.pmod(bits, F.lit(n))
    inner = lambda k, n, *more: _random(k, n, [*path, *more])
    places = F.sequence(F.lit(0), below(4).cast("int"))
    if isinstance(kind, T.StructType):
        value = F.struct(*(inner(f.dataType, nulls, F.lit(i)).alias(f.name) for i, f in enumerate(kind.fields)))
    elif isinstance(kind, T.ArrayType):
        value = F.transform(places, lambda i: inner(kind.elementType, nulls, i))
    elif isinstance(kind, T.MapType):
        keys = F.array_distinct(F.transform(places, lambda i: inner(kind.keyType, 0.0, i)))
        value = F.map_from_arrays(keys, F.transform(keys, lambda k, i: inner(kind.valueType, nulls, i, F.lit("v"))))
    elif isinstance(kind, T.StringType):
        value = F.md5(bits.cast("string"))
    elif isinstance(kind, T.BinaryType):
        value = F.unhex(F.md5(bits.cast("string")))
    elif isinstance(kind, T.BooleanType):
        value = below(2) == 1
    elif isinstance(kind, T.DecimalType):
        value = (F.pmod(bits, F.lit(10 ** min(kind.precision, 18))).cast("decimal(38,0)") / F.lit(10**kind.scale).cast("decimal(38,0)")).cast(kind)
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        value = F.timestamp_seconds(below(2**32)).cast(kind)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        value = ((unit - 0.5) * 2e6).cast(kind)
    else:
        most = {"byte": 2**7, "short": 2**15, "integer": 2**31}.get(kind.typeName())
        value = (bits if most is None else below(2 * most) - most).cast(kind)
    return F.when(F.pmod(F.xxhash64(F.lit("null"), *path), F.lit(1000)) >= int(nulls * 1000), value) if nulls else value


def random_rows(spark: SparkSession, n: int, seed: int = 0, nulls: float = 0.1, schema: StructType | str | None = None) -> DataFrame:
    """Random rows, made on the executors: of a schema with any nesting, or of common types."""
    if schema is not None:
        wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return spark.range(n).select(*(_random(f.dataType, nulls, [F.col("id"), F.lit(seed), F.lit(i)]).alias(f.name) for i, f in enumerate(wanted.fields)))
    some = lambda c, k: F.when(F.rand(seed + k) >= nulls, c)
    return spark.range(n).select("id", some((F.rand(seed + 1) * 1000).cast("int"), 10).alias("i"), some(F.randn(seed + 2), 11).alias("d"), some(F.md5((F.rand(seed + 3) * 100).cast("int").cast("string")), 12).alias("s"), some(F.rand(seed + 4) < 0.5, 13).alias("b"))
