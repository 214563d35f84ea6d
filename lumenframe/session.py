"""Session settings for a dialect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Spark-dialect arithmetic wraps and gives null; Presto-dialect arithmetic is checked and raises.
DIALECTS = {
    "spark": {"spark.sql.ansi.enabled": "false", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"},
    "presto": {"spark.sql.ansi.enabled": "true", "spark.sql.mapKeyDedupPolicy": "EXCEPTION"},
    "flink": {"spark.sql.ansi.enabled": "false", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"},
}
COMMON = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None, dialect: str = "presto", app: str = "lumenframe", **conf: str) -> SparkSession:
    """A session with the dialect's settings; on a cluster leave master to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=COMMON | DIALECTS[dialect] | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def use_dialect(spark: SparkSession, dialect: str) -> SparkSession:
    """A new session of the same application with another dialect's settings."""
    other = spark.newSession()
    for k, v in (COMMON | DIALECTS[dialect]).items():
        other.conf.set(k, v) if k != "spark.sql.execution.arrow.pyspark.enabled" else None
    return other
