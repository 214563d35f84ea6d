"""Structured Streaming over event tables: windows with watermarks, deduplication and sessions."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream over the Parquet files of a folder or glob."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, every: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of tumbling windows; state older than the watermark is dropped."""
    rows = events.withWatermark(time, late)
    return rows.groupBy(F.window(time, every), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def deduplicated(events: DataFrame, time: str, late: str | None, *keys: str) -> DataFrame:
    """One row of each key. Without a bound on lateness every key is remembered and no row is dropped as late, however files fall into batches."""
    if late is None:
        return events.dropDuplicates(list(keys))
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def sliding_counts(events: DataFrame, time: str, length: str, every: str, late: str, *keys: str) -> DataFrame:
    """Counts of windows that overlap: a row counts in each window that holds its time."""
    rows = events.withWatermark(time, late)
    return rows.groupBy(F.window(time, length, every), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Counts of a key's rows that follow one another within a gap."""
    rows = events.withWatermark(time, late)
    return rows.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), *keys, "n")


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """Count, sum and greatest value of each key so far, kept in state from batch to batch; a row for each key that a batch touches."""

    def update(keys, batches, state):
        n, total, most = state.get if state.exists else (0, 0.0, None)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf[value].sum())
            top = float(pdf[value].max())
            most = top if most is None else max(most, top)
        state.update((n, total, most))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total], "most": [most]})

    return events.select(key, value).groupBy(key).applyInPandasWithState(update, f"{key} long, n long, total double, most double", "n long, total double, most double", "update", "NoTimeout")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/lumenframe-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that is available now, through the streaming engine, as a table of files in the shared folder.

    Each batch is written by its number, so one that is repeated after a failure
    replaces itself; state and offsets are in a checkpoint beside them. A complete
    result is the last batch's; in update and append mode all batches' rows are read.
    """
    spark, folder, batches = stream.sparkSession, shared_folder(stream.sparkSession, "stream"), []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        batches.append(number)

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    chosen = batches[-1:] if mode == "complete" else sorted(set(batches))
    rows = spark.read.schema(stream.schema).parquet(*(f"{folder}/rows/batch={n}" for n in chosen))
    return rows.select(*stream.columns)
