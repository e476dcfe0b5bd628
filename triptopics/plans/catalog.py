"""Registry of named queries: Spark builder + (optionally) an oracle SQL text.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the driver tables.  The SQL twin (DuckDB dialect, tables pre-registered
as views) must return the same columns under the same names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    sql: str | None
    operators: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, ops: tuple[str, ...] = ()):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ops)
        return fn
    return deco


def with_views(body: str, **views: str) -> str:
    """Prefix ``body`` with CTEs ``name AS (sql)``."""
    ctes = ",\n".join(f"{k} AS ({v})" for k, v in views.items())
    return f"WITH {ctes}\n{body}" if ctes else body
