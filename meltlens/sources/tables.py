"""Parquet table scans over a scale-factor directory.

Reads are lazy; column pruning and predicate pushdown happen in Catalyst
because every consumer selects only what it needs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Register the given tables as temp views (for ``spark.sql`` users)."""
    for name in names or TABLES:
        path = table_path(sf_dir, name)
        if os.path.exists(path):
            read_table(spark, sf_dir, name).createOrReplaceTempView(name)
