"""Merge-on-read tables: primary-key engines over sorted runs, and deletion vectors.

A table is a set of files whose rows carry a sequence number; what a reader sees
of each key is decided by the merge engine. All are one aggregation by key with
partial combination before the shuffle, so a key with many versions is no hot
spot; none sorts or windows a key's versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rest(df: DataFrame, keys: list[str], sequence: str) -> list[str]:
    return [c for c in df.columns if c not in keys and c != sequence]


def deduplicate(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The last row of each key."""
    return _pick(df, keys, sequence, F.max_by)


def first_row(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The first row of each key."""
    return _pick(df, keys, sequence, F.min_by)


def _pick(df: DataFrame, keys: list[str], sequence: str, by: Callable) -> DataFrame:
    row = by(F.struct(*df.columns), F.struct(F.col(sequence), *_comparable(df, keys, sequence)))
    return df.groupBy(*keys).agg(row.alias("_row")).select("_row.*")


def _comparable(df: DataFrame, keys: list[str], sequence: str) -> list[Column]:
    """Columns that settle ties of the sequence: all that can be ordered."""
    return [F.col(c) for c, t in df.dtypes if c not in keys and c != sequence and not t.startswith("map")]


def partial_update(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """For each column of each key, the last value that is not null."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(sequence))).alias(c) for c in _rest(df, keys, sequence)]
    return df.groupBy(*keys).agg(F.max(sequence).alias(sequence), *last).select(*df.columns)


#: Field aggregates by name: functions of (column, sequence column).
FIELD_AGGREGATES: dict[str, Callable[[str, str], Column]] = {
    "sum": lambda c, s: F.sum(c), "product": lambda c, s: F.product(c), "max": lambda c, s: F.max(c), "min": lambda c, s: F.min(c), "count": lambda c, s: F.count(c), "bool_and": lambda c, s: F.bool_and(c), "bool_or": lambda c, s: F.bool_or(c),
    "first_value": lambda c, s: F.min_by(c, s), "last_value": lambda c, s: F.max_by(c, s),
    "first_non_null_value": lambda c, s: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(s))), "last_non_null_value": lambda c, s: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(s))),
    "listagg": lambda c, s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(s).alias("s"), F.col(c).alias("c"))))), lambda x: x["c"]), ","),
    "collect": lambda c, s: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(s).alias("s"), F.col(c).alias("c"))))), lambda x: x["c"]),
}


def aggregation(df: DataFrame, keys: list[str], sequence: str, fields: dict[str, str]) -> DataFrame:
    """Each column of each key by its field aggregate; the last value that is not null where none is named."""
    columns = [FIELD_AGGREGATES[fields.get(c, "last_non_null_value")](c, sequence).alias(c) for c in _rest(df, keys, sequence)]
    return df.groupBy(*keys).agg(F.max(sequence).alias(sequence), *columns).select(*df.columns)


ENGINES = {"deduplicate": deduplicate, "first-row": first_row, "partial-update": partial_update}


def with_positions(df: DataFrame) -> DataFrame:
    """df read from Parquet files, with each row's file and place in it."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_position"))


def apply_deletions(df: DataFrame, deletions: DataFrame) -> DataFrame:
    """df without the rows that deletion vectors (file, position) name; the vectors are broadcast only where the planner finds them small."""
    rows = with_positions(df)
    gone = deletions.select(F.col("file").alias("_file"), F.col("position").alias("_position"))
    return rows.join(gone, ["_file", "_position"], "left_anti").drop("_file", "_position")
