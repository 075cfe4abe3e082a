"""Fleet analytics (A*) as aggregates over the scored table.

Every statistic over many columns is one aggregate job; wide results are
unpivoted with ``stack``-style ``explode(array(struct))`` and ranked with a
top-k (``orderBy(...).limit(k)`` -> TakeOrderedAndProject, no global sort).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import severity_from_score


def value_counts(df: DataFrame, col: str | Column, name: str = "n") -> DataFrame:
    """Counts per value, descending (ties by value)."""
    c = F.col(col) if isinstance(col, str) else col
    return df.groupBy(c).agg(F.count(F.lit(1)).alias(name))


def unpivot(df_one_row: DataFrame, columns: Sequence[str], key: str = "column", value: str = "value") -> DataFrame:
    """Wide one-row (or small) frame -> long ``(key, value)`` rows."""
    return df_one_row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias(key), F.col(c).cast("double").alias(value)) for c in columns
    ])).alias("kv")).select("kv.*")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def class_mean_differences(df: DataFrame, columns: Sequence[str], label: str = "defect") -> DataFrame:
    """``|mean(x | y=1) - mean(x | y=0)|`` per column in one aggregate."""
    y = F.col(label)
    wide = df.agg(*[
        F.abs(F.avg(F.when(y == 1, F.col(c))) - F.avg(F.when(y == 0, F.col(c)))).alias(c) for c in columns
    ])
    return unpivot(wide, columns, "parameter", "abs_mean_diff")


def defect_drivers(df: DataFrame, columns: Sequence[str], label: str = "defect", prob: str = "defect_prob") -> DataFrame:
    """``parameter, impact``: the absolute difference of class means where the label has both classes,
    else the absolute correlation with the probability; one aggregate holds both, and the plan picks."""
    y = F.coalesce(F.col(label).cast("int"), F.lit(0))
    given = F.col(label).isNotNull()
    aggs = [((F.min(F.when(given, y)) == 0) & (F.max(F.when(given, y)) == 1)).alias("__both")]
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.abs(F.avg(F.when(y == 1, x)) - F.avg(F.when(y == 0, x))).alias(f"d{i}"),
                 F.abs(F.corr(x, F.col(prob).cast("double"))).alias(f"r{i}")]
    wide = df.agg(*aggs)
    both = F.coalesce(F.col("__both"), F.lit(False))
    return unpivot(wide.select(*[F.when(both, F.col(f"d{i}")).otherwise(F.col(f"r{i}")).alias(c) for i, c in enumerate(columns)]),
                   columns, "parameter", "impact")


def target_correlations(df: DataFrame, columns: Sequence[str], target: str = "defect") -> DataFrame:
    """Pearson correlation of every column with the target, one aggregate."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    return unpivot(wide, columns, "feature", "corr")


def wide_agg_row(df: DataFrame, aggs: Sequence[Column], buffer_fields: int) -> dict:
    """Evaluate many aggregates as one-row results, in as few scans as keep
    each aggregate inside whole-stage codegen (``spark.sql.codegen.maxFields``
    bounds the buffer width; beyond it Spark falls back to interpreted code,
    roughly 10x slower)."""
    limit = int(df.sparkSession.conf.get("spark.sql.codegen.maxFields", "100"))
    per_chunk = max(1, (limit - 1) // max(buffer_fields, 1))
    out: dict = {}
    for i in range(0, len(aggs), per_chunk):
        out.update(df.agg(*aggs[i:i + per_chunk]).first().asDict())
    return out


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairwise correlations (pairwise-complete), one codegen'd
    aggregate per chunk of pairs; the result is n(n+1)/2 numbers."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = wide_agg_row(df, [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}")
                             for i, (a, b) in enumerate(pairs)], buffer_fields=6)
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows.append((a, b, wide[f"p{i}"]))
        if a != b:
            rows.append((b, a, wide[f"p{i}"]))
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


def histogram(df: DataFrame, col: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width histogram; bounds from one min/max aggregate unless given.
    Last bin is closed on the right (numpy semantics)."""
    if lo is None or hi is None:
        r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
        lo, hi = float(r["lo"]), float(r["hi"])
    width = (hi - lo) / bins if hi > lo else 1.0
    x = F.col(col)
    b = F.when(x == hi, bins - 1).otherwise(F.floor((x - lo) / width).cast("int"))
    return (df.where(x.isNotNull() & (x >= lo) & (x <= hi)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (F.lit(lo) + F.col("bin") * width).alias("bin_start"),
                    (F.lit(lo) + (F.col("bin") + 1) * width).alias("bin_end"), "n"))


def five_number_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """Exact min / q1 / median / q3 / max per group (linear interpolation).

    Quartiles come from the distributed exact-quantile plan grouped by ``by``,
    so a group holding a third of all rows is still split across tasks."""
    from ..plans.ordered import exact_quantiles, join_on_keys
    q = exact_quantiles(df, [value], [0.25, 0.5, 0.75], by=by)
    wide = q.groupBy(by).agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
                               for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    mm = df.groupBy(by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count(F.lit(1)).alias("n"))
    return join_on_keys(mm, wide, [by]).select(by, "min", "q1", "median", "q3", "max", "n")


def with_severity(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """M15 label + int rank, and ``anomaly_flag`` (HIGH RISK or worse)."""
    sev = severity_from_score(F.col(score))
    return df.withColumn("anomaly_severity", sev).withColumn(
        "anomaly_flag", F.col(score).__ge__(config.SEVERITY_CUTS[2]).cast("int"))
