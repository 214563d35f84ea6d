"""Registered queries, by module: each has a Spark form and, where SQL can say it, a SQL form."""

from __future__ import annotations

from . import aggregates, dialect_functions, python_surface, relational, scalars, storage, tpch, windows

MODULES = (tpch, relational, windows, scalars, dialect_functions, aggregates, storage, python_surface)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
