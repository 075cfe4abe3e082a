"""Training corpus in five stages, each written as Parquet and reread as the next one's documents.

quality rules -> one document of each near-duplicate group -> decontamination ->
secrets masked -> packed token sequences.  All stages but the last return the
columns of ``documents``; the last returns one row per packed piece.  Each stage
works on all rows its predecessor kept, and inherits the defined results of its
operator for nulls, empty texts, repeated rows and empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meltlens.llm import decontamination, jaccard_join, packing, quality_rules, secret_scan
from meltlens.llm.common import scratch_path, table
from meltlens.llm.tokens import LEAN
from meltlens.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and every quality rule."""
    ship_package(spark)
    return quality_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (the smallest id)."""
    ship_package(spark)
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those contaminated by the benchmark."""
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` counted anew where a text changed."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in packed sequences."""
    ship_package(spark)
    return packing.pack_documents(docs, sizes=LEAN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]
#: The packing stage has no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
