"""Order-dependent computations without single-partition windows.

A window with ``orderBy`` but no (or a hot) ``partitionBy`` funnels every row
of a group through one task.  At cluster scale one key may hold a third of
the data, so running totals are computed the way a distributed sort does it:

1. range-partition on ``(keys, order)`` -- balanced by sampling, a hot key is
   split across many partitions;
2. running totals inside each range partition (window clustered by the range
   partition id: every group is at most one range partition);
3. per-partition totals (at most one row per partition and key) give the
   offset each partition's *first* key inherits from earlier partitions --
   only the first key of a range partition can continue an earlier one;
4. the offsets table has at most one row per range partition, a size bounded
   by the partition count, so it is broadcast.

The order columns must make the order total within a key (unique), otherwise
ties would be split arbitrarily; callers pre-aggregate ties first.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

_PID = "__rt_pid"


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], exact: Sequence[str] = (),
                 how: str = "left") -> DataFrame:
    """Equi-join in which a NULL key meets a NULL key; ``exact`` columns join as usual.
    The right side's key columns are dropped."""
    names = {k: f"__right_{k}" for k in (*keys, *exact)}
    other = right.withColumnsRenamed(names)
    cond = [left[k].eqNullSafe(other[names[k]]) for k in keys] + [left[k] == other[names[k]] for k in exact]
    return left.join(other, cond, how).drop(*names.values())


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    num_partitions: int | None = None,
) -> DataFrame:
    """Append inclusive running sums ``name -> sum(expr)`` per ``keys`` in
    ``order`` (ascending).  Keys may be empty (one global order)."""
    keys, order = list(keys), list(order)
    n = _num_partitions(df, num_partitions)
    base = df.select("*", *[e.alias(f"__v_{k}") for k, e in sums.items()])
    ranged = base.repartitionByRange(n, *[F.col(c) for c in keys + order]).withColumn(
        _PID, F.spark_partition_id()
    )
    w_local = (
        Window.partitionBy(_PID, *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.select(
        "*", *[F.sum(f"__v_{k}").over(w_local).alias(f"__loc_{k}") for k in sums]
    )
    # Range bounds come from a sample whose seed depends on the RDD id, so two
    # evaluations of `ranged` may split differently.  Materialise once
    # (reliable checkpoint in the shared checkpoint dir) and derive the
    # per-partition totals from the same rows.
    local = cut_lineage(local)
    # per (partition, key) totals; only keys spanning partitions need offsets
    totals = local.groupBy(_PID, *keys).agg(*[F.sum(f"__v_{k}").alias(f"__tot_{k}") for k in sums])
    w_prev = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    with_prev = totals.select(
        _PID, *keys, *[F.coalesce(F.sum(f"__tot_{k}").over(w_prev), F.lit(0)).alias(f"__off_{k}") for k in sums]
    )
    offsets = with_prev
    if keys:
        # keep the first key of each range partition: <= 1 row per partition
        first_key = local.groupBy(_PID).agg(F.min(F.struct(*keys)).alias("__first")).select(
            _PID, *[F.col("__first")[k].alias(k) for k in keys])
        offsets = join_on_keys(with_prev, first_key, keys, [_PID], "inner")
    out = join_on_keys(local, F.broadcast(offsets), keys, [_PID])
    return out.select(
        *[c for c in df.columns],
        *[(F.col(f"__loc_{k}") + F.coalesce(F.col(f"__off_{k}"), F.lit(0))).alias(k) for k in sums],
    )


def row_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn",
                  num_partitions: int | None = None) -> DataFrame:
    """1-based row position per key in ``order`` (order must be unique per key)."""
    out = running_totals(df, keys, order, {name: F.lit(1).cast("long")}, num_partitions)
    return out


def with_positions(df: DataFrame, name: str = "position") -> DataFrame:
    """``df`` with each row's place in the frame's own order (partitions in turn), from 0.

    The frame is stored once; only a row count per partition is needed to place its rows, so
    nothing is sorted and no window spans the table."""
    kept = cut_lineage(df.withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}))
    parts = kept.groupBy("__part").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition, whatever the data's size
    bases = parts.select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__base"))
    placed = kept.join(F.broadcast(bases), "__part").withColumn(name, F.col("__base") + F.col("__id"))
    return placed.select(*df.columns, name)


def attach_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row i of ``left`` beside row i of ``right``; rows without a partner are left out.

    Columns of ``right`` that ``left`` has, too, get the suffix ``_right``. Both sides are whole tables: they are merged,
    since the size estimated from compressed files may let Spark broadcast one of them."""
    names = {c: f"{c}_right" for c in right.columns if c in left.columns}
    other = with_positions(right.withColumnsRenamed(names), "__position")
    return with_positions(left, "__position").join(other.hint("merge"), "__position").drop("__position")


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    num_partitions: int | None = None,
    by: str | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas / ``quantile_cont``) for many
    columns (optionally per group ``by``) in one distributed job.  Returns long
    rows ``(column, [by,] prob, value)``.

    Values are unpivoted, pre-aggregated to distinct ``(column, value)`` counts
    (map-side combine), ranked with :func:`running_totals` and the two order
    statistics around each target position are picked with an equi-join on the
    column name against a target table of ``len(columns) * len(probs)`` rows
    (times the number of groups).  No task ever holds all values of a column
    or of a group.
    """
    spark = df.sparkSession
    grp = [by] if by else []
    stack = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    ).alias("kv")
    long = df.select(*grp, stack).select(*grp, "kv.column", "kv.value").where(
        F.col("value").isNotNull() & ~F.isnan("value"))
    counts = long.groupBy("column", *grp, "value").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = running_totals(counts, ["column", *grp], ["value"], {"cum": F.col("cnt")}, num_partitions)
    ranked = ranked.withColumn("start", F.col("cum") - F.col("cnt"))
    n_per = ranked.groupBy("column", *grp).agg(F.max("cum").alias("n"))
    target = n_per.crossJoin(
        F.broadcast(spark.createDataFrame([(float(p),) for p in probs], "prob double"))
    ).select(
        "column", *grp, "prob",
        (F.col("prob") * (F.col("n") - 1)).alias("pos"),
    ).select(
        "column", *grp, "prob", "pos",
        F.floor("pos").cast("long").alias("lo"),
        F.ceil("pos").cast("long").alias("hi"),
    )
    # the target table has one row per (column, group, prob); broadcast it
    # only when there are no groups (size proven by the arguments)
    joined = join_on_keys(ranked, F.broadcast(target) if not grp else target, grp, ["column"], "inner")
    picked = joined.where(
        ((F.col("lo") >= F.col("start")) & (F.col("lo") < F.col("cum")))
        | ((F.col("hi") >= F.col("start")) & (F.col("hi") < F.col("cum")))
    )
    agg = picked.groupBy("column", *grp, "prob", "pos", "lo").agg(
        F.max(F.when((F.col("lo") >= F.col("start")) & (F.col("lo") < F.col("cum")), F.col("value"))).alias("v_lo"),
        F.max(F.when((F.col("hi") >= F.col("start")) & (F.col("hi") < F.col("cum")), F.col("value"))).alias("v_hi"),
    )
    return agg.select(
        "column", *grp, "prob",
        (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("pos") - F.col("lo"))).alias("value"),
    )


def quantile_row(df: DataFrame, columns: Sequence[str], probs: Sequence[float], prefix: str = "",
                 num_partitions: int | None = None) -> DataFrame:
    """One-row DataFrame with columns ``{prefix}{col}_q{int(p*100)}`` (exact)."""
    q = exact_quantiles(df, columns, probs, num_partitions)
    aggs = []
    for c in columns:
        for p in probs:
            aggs.append(
                F.max(F.when((F.col("column") == c) & (F.col("prob") == float(p)), F.col("value")))
                .alias(f"{prefix}{c}_q{int(round(p * 100))}")
            )
    return q.agg(*aggs)


def median_row(df: DataFrame, columns: Sequence[str], prefix: str = "med_",
               num_partitions: int | None = None) -> DataFrame:
    """One-row DataFrame of exact medians ``{prefix}{col}``."""
    q = exact_quantiles(df, columns, [0.5], num_partitions)
    return q.agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"{prefix}{c}") for c in columns])
