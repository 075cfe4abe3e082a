"""Size-checked lookups (attach a small statistics table to a fact table)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 100_000


def materialize_if_small(lookup: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Run ``lookup`` once with a row cap of ``max_rows + 1``.

    If it fits, return it re-created from the fetched rows (so the fact-side
    plan does not recompute the aggregate) together with ``True``; otherwise
    return the lazy frame and ``False``.  The fetch is bounded by
    ``max_rows + 1`` rows whatever the input size.
    """
    rows = lookup.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        spark = lookup.sparkSession
        return spark.createDataFrame(rows, lookup.schema), True
    return lookup, False


def attach(fact: DataFrame, lookup: DataFrame, on: Sequence[str] | str, how: str = "left",
           max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Join ``lookup`` onto ``fact``: broadcast when the lookup is proven small,
    a shuffle join (AQE may still convert / split skew) when it is not."""
    small, ok = materialize_if_small(lookup, max_rows)
    return fact.join(F.broadcast(small) if ok else small, on=on, how=how)


def attach_scalar_row(fact: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a global one-row statistics frame (J5): a one-row broadcast."""
    return fact.crossJoin(F.broadcast(one_row))


def own_stage(df: DataFrame) -> DataFrame:
    """End the generated code of a long expression chain here.

    Coalescing to more partitions than there are moves no row and changes no
    partition, but it is not part of whole-stage code generation, so what stands
    above and below is compiled as two methods of a size the compiler takes.
    """
    return df.coalesce(1_000_000)


def spread(scan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deal the rows of a plain scan over all cores where its files give fewer partitions than there are cores.

    A table in a few files (or one row group) would leave a long row-local stage to a few tasks. Larger inputs, which
    have more partitions than cores anyway, are read as they are, without a shuffle. Rows go by the hash of their
    (near) unique ``keys``, so a rerun task sends the same rows. Only for scans: a frame with a shuffle of its own
    would be run to learn its partitions.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan.rdd.getNumPartitions() < cores else scan
