"""Query registry: one entry per inventory operator, each with its SQL twin.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``
(DuckDB SQL over the raw parquet views).  Entries without an oracle are
checked rows-only (model fitting, iterative algorithms).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module (each registers its queries on import)."""
    from ..catalog import (  # noqa: F401
        core, cleaning, analytics, evaluation, models, neighbours, sources_sinks, schema_ops, extras, reports,
    )
