"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lookup import materialize_if_small
from ..session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take Spark's fast ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_of(value: Column) -> Column:
    """A grouping key that is never null; keys sort as the values' UTF-8 bytes do, null first."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), value.cast("string")))


#: Rows up to which a lookup is broadcast, and the parts into which a larger one deals each key.
MAX_LOOKUP_ROWS, LOOKUP_PARTS = 10_000, 64


def attach_by_key(df: DataFrame, lookup: DataFrame, key: str, spread: Column) -> DataFrame:
    """``df`` with the columns of ``lookup`` (one row per key).

    A lookup of at most MAX_LOOKUP_ROWS rows is broadcast.  A larger one is joined in
    LOOKUP_PARTS parts of each key, chosen by ``spread``, so that a hot key is no one task."""
    small, fits = materialize_if_small(lookup, MAX_LOOKUP_ROWS)
    if fits:
        return df.join(F.broadcast(small), key)
    parts = lookup.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(LOOKUP_PARTS - 1))))
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(spread), F.lit(LOOKUP_PARTS)).cast("int"))
    return dealt.join(parts, [key, "__part"]).drop("__part")


def row_batches(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches into slices of at most ``rows`` rows (bounds worker memory)."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at:at + rows]
