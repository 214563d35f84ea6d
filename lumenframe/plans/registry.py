"""How plan modules declare their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables:
    """Tables of a folder, read on first use: ``t.lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


class Registry:
    """Queries of one module: ``QUERIES`` and ``ORACLE_SQL``."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Decorator for a function of Tables."""

        def put(f: Callable[[Tables], DataFrame]):
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql is not None:
                self.oracle[name] = sql
            return f

        return put

    def sql(self, name: str, spark_sql: str, duck_sql: str | None = None, oracle: bool = True) -> None:
        """A query in SQL; ``{table}`` stands for a table. Where the two dialects agree, one text serves both."""
        used = [t for t in TABLES if f"{{{t}}}" in spark_sql]
        text = spark_sql.replace("{", "{{").replace("}", "}}")
        for u in used:
            text = text.replace(f"{{{{{u}}}}}", f"{{{u}}}")

        def run(t: Tables) -> DataFrame:
            return t.spark.sql(text, **{u: getattr(t, u) for u in used})

        plain = duck_sql or spark_sql
        for t in TABLES:
            plain = plain.replace(f"{{{t}}}", t)
        self.add(name, plain if oracle else None)(run)

    def columns(self, name: str, source: str, columns: dict[str, str | tuple[str, str]], keys: str = "") -> None:
        """A projection of expressions; a pair gives Spark's form and the oracle's."""
        both = {k: (v, v) if isinstance(v, str) else v for k, v in columns.items()}
        lead = f"{keys}, " if keys else ""
        form = lambda i: f"SELECT {lead}" + ", ".join(f"{v[i]} AS {k}" for k, v in both.items()) + f" FROM {source}"
        self.sql(name, form(0), form(1))
