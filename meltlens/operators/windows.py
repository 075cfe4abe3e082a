"""Order-dependent operators (W1-W4) built on hot-key-safe running totals.

``Window.partitionBy(key).orderBy(seq)`` sends each key to one task; with a
key holding a third of all rows that task is the job.  Here every position,
running sum and fill is a running total over a range-partitioned order plus
equi-joins on unique ``(key, position)`` pairs, so no task ever holds more
than one range partition.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import join_on_keys, running_totals


def rolling_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, window: int = 50,
                 min_periods: int = 2, out: str | None = None, fill: bool = True) -> DataFrame:
    """Trailing ``window``-row mean per key (NULL and NaN skipped, at least
    ``min_periods`` values), then back-fill and forward-fill per key.

    ``order`` must be unique within a key.
    """
    out = out or f"rolling_{value}"
    keys = list(keys)
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)  # a NaN would stay in every later prefix sum
    ranked = running_totals(df, keys, [order], {
        "__rn": F.lit(1).cast("long"),
        "__cs": F.coalesce(v, F.lit(0.0)),
        "__cc": v.isNotNull().cast("long"),
    })
    prev = ranked.select(*keys, (F.col("__rn") + window).alias("__rn"),
                         F.col("__cs").alias("__cs_prev"), F.col("__cc").alias("__cc_prev"))
    w = join_on_keys(ranked, prev, keys, ["__rn"])
    cnt = F.col("__cc") - F.coalesce(F.col("__cc_prev"), F.lit(0))
    tot = F.col("__cs") - F.coalesce(F.col("__cs_prev"), F.lit(0.0))
    mean = w.select(*df.columns, "__rn", F.when(cnt >= min_periods, tot / cnt).alias("__m"))
    if not fill:
        return mean.withColumnRenamed("__m", out).drop("__rn")
    return _fill_both(mean, keys, "__rn", "__m", out).drop("__rn")


def _fill_both(df: DataFrame, keys: list[str], pos: str, val: str, out: str) -> DataFrame:
    """Back-fill then forward-fill ``val`` along ``pos`` per key (exact).

    The next valid row of a row is the valid row with the same count of valid
    rows at-or-after it (descending running count); the previous valid row the
    one with the same count at-or-before.  Both are equi-joins on unique keys.
    """
    valid = F.col(val).isNotNull().cast("long")
    cols = df.columns
    a = running_totals(df.withColumn("__neg", -F.col(pos)), keys, ["__neg"], {"__after": valid})
    a = running_totals(a.drop("__neg"), keys, [pos], {"__before": valid})
    nxt = a.where(F.col(val).isNotNull()).select(*keys, F.col("__after").alias("__after"),
                                                 F.col(val).alias("__next"))
    prv = a.where(F.col(val).isNotNull()).select(*keys, F.col("__before").alias("__before"),
                                                 F.col(val).alias("__prev"))
    j = join_on_keys(join_on_keys(a, nxt, keys, ["__after"]), prv, keys, ["__before"])
    return j.select(*[c for c in cols if c != val], F.coalesce(F.col(val), F.col("__next"), F.col("__prev")).alias(out))


def cumulative_share(df: DataFrame, order: str, value: str, out: str = "cumulative") -> DataFrame:
    """Cumulative sum of ``value`` in ``order`` (one global order)."""
    return running_totals(df, [], [order], {out: F.col(value).cast("double")})
