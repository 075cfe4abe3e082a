"""Cleaning operators.

Data-driven typing needs one profiling action before the plan is known: all
column fractions / null counts come from ONE aggregate row, and every
statistic (medians, quartiles, modes) from one distributed job per repair
step -- never one job per column, never a whole column in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import finite_or_null, sentinel_to_numeric
from ..plans.lookup import attach_scalar_row
from ..plans.ordered import exact_quantiles
from ..session import cut_lineage
from . import schema as H


# ---------------------------------------------------------------------------
# C1 / C2 / C3 row and column drops
# ---------------------------------------------------------------------------
def drop_empty_rows(df: DataFrame) -> DataFrame:
    """C1 (rows): drop rows where every column is NULL."""
    return df.na.drop(how="all")


def drop_empty_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """C1 (columns): one ``count(col)`` aggregate decides which columns are all NULL."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first().asDict()
    empty = [c for c in df.columns if row[c] == 0]
    return df.drop(*empty), empty


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed (hash shuffle on the full row)."""
    return df.dropDuplicates()


def count_duplicate_rows(df: DataFrame) -> DataFrame:
    """C2 with its report: every different row once, with ``n_copies``; NULLs are equal. One shuffle with map-side counts."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n_copies"))


def drop_null_target(df: DataFrame, target: str = "defect") -> DataFrame:
    """C3."""
    return df.where(F.col(target).isNotNull())


# ---------------------------------------------------------------------------
# C6 / C7 profile: fractions and missing counts in one aggregate
# ---------------------------------------------------------------------------
def numeric_profile(df: DataFrame, columns: Sequence[str], strip_percent: bool = False) -> dict:
    """Fraction of parseable values and converted-null count per column, plus
    the row count -- one aggregate job, one row back to the driver."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in columns:
        conv = sentinel_to_numeric(F.col(c), strip_percent)
        aggs.append(F.avg(conv.isNotNull().cast("double")).alias(f"{c}__frac"))
        aggs.append(F.count_if(conv.isNull()).alias(f"{c}__miss"))
    return df.agg(*aggs).first().asDict()


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n_missing, pct_missing)`` sorted descending, nonzero only."""
    prof = df.agg(F.count(F.lit(1)).alias("n"), F.array(*[
        F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_missing")) for c in columns
    ]).alias("m"))
    return (prof.select("n", F.explode("m").alias("x"))
            .select("x.column", "x.n_missing",
                    F.round(F.col("x.n_missing") * 100.0 / F.col("n"), 6).alias("pct_missing"))
            .where(F.col("n_missing") > 0))


# ---------------------------------------------------------------------------
# C8 / C9 imputation, C10 range check, C11 IQR clip, C12 mode fill, C13
# ---------------------------------------------------------------------------
def median_map(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact medians of many columns as one long frame ``(column, prob, value)``."""
    return exact_quantiles(df, columns, [0.5])


def impute_median(df: DataFrame, columns: Sequence[str], medians: dict[str, float] | None = None) -> DataFrame:
    """C8 (per-frame medians, exact) or C9 (given training medians)."""
    if not columns:
        return df
    if medians is not None:
        return df.fillna({c: float(v) for c, v in medians.items() if c in columns})
    # statistics are tiny (one value per column): fetch them and fold them in
    # as literals so later steps do not re-run this job inside their lineage
    med = {r["column"]: r["value"] for r in median_map(df, columns).collect()}
    return df.select(*[
        F.coalesce(F.col(c), F.lit(med.get(c)).cast("double")).alias(c) if c in columns else F.col(c)
        for c in df.columns])


def null_impossible(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Values outside the physical range -> NULL (only present columns)."""
    ranges = ranges or config.IMPOSSIBLE_RANGES
    repl = {}
    for c, (lo, hi) in ranges.items():
        if c in df.columns:
            repl[c] = F.when(~((F.col(c) < lo) | (F.col(c) > hi)) | F.col(c).isNull(), F.col(c))
    return df.withColumns(repl) if repl else df


def impossible_counts(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """C10 report: ``(column, lo, hi, n_impossible)`` in one aggregate."""
    ranges = ranges or config.IMPOSSIBLE_RANGES
    present = [(c, lo, hi) for c, (lo, hi) in ranges.items() if c in df.columns]
    agg = df.agg(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"),
                 F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias("n_impossible"))
        for c, lo, hi in present]).alias("r"))
    return agg.select(F.explode("r").alias("x")).select("x.*")


def iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float = config.IQR_FACTOR) -> DataFrame:
    """Exact linear quartiles -> ``(column, q1, q3, lo, hi)`` (one job)."""
    q = exact_quantiles(df, columns, [0.25, 0.75])
    wide = q.groupBy("column").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"),
    )
    iqr = F.col("q3") - F.col("q1")
    return wide.select("column", "q1", "q3", (F.col("q1") - iqr * factor).alias("lo"),
                       (F.col("q3") + iqr * factor).alias("hi"))


def clip_iqr(df: DataFrame, columns: Sequence[str], factor: float = config.IQR_FACTOR) -> DataFrame:
    """C11: clip to ``[q1 - f*IQR, q3 + f*IQR]``; NULL stays NULL."""
    if not columns:
        return df
    bounds = {r["column"]: (r["lo"], r["hi"]) for r in iqr_bounds(df, columns, factor).collect()}
    out = []
    for c in df.columns:
        if c in columns and c in bounds:
            x = F.col(c)
            lo, hi = F.lit(bounds[c][0]).cast("double"), F.lit(bounds[c][1]).cast("double")
            out.append(F.when(x.isNotNull(), F.greatest(F.least(x, hi), lo)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent non-NULL value per column, smallest on ties:
    ``(column, mode)``.  Counts are a distributed group-by; the pick is a
    partial ``min(struct(-count, value))`` -- no column is held in one task."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("kv")).select("kv.*").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("value"))).alias("b"))
    return best.select("column", F.col("b.value").alias("mode"))


def fill_mode(df: DataFrame, columns: Sequence[str], unknown: str = "UNKNOWN") -> DataFrame:
    """Fill categorical NULLs with the column mode (``UNKNOWN`` if none)."""
    if not columns:
        return df
    m = {r["column"]: r["mode"] for r in modes(df, columns).collect()}  # one row per column
    return df.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit(m.get(c)).cast("string"), F.lit(unknown)).alias(c)
        if c in columns else F.col(c) for c in df.columns])


def non_finite_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """C13."""
    cols = columns if columns is not None else H.numeric_columns(df)
    return df.withColumns({c: finite_or_null(F.col(c)) for c in cols}) if cols else df


# ---------------------------------------------------------------------------
# C14 / C16 / C17 / C18 profile-based rescaling
# ---------------------------------------------------------------------------
def unit_interval_by_profile(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """C14: repair a score column to [0, 1] by its column profile:
    max<=1 keep; max<=100 and >=40 % of rows > 1 -> /100; max<=100 otherwise
    clip; max>100 min-max; NULL -> 0.  One aggregate + one-row broadcast."""
    out = out or col
    v = finite_or_null(F.col(col))
    prof = df.agg(F.max(v).alias("__mx"), F.min(v).alias("__mn"),
                  F.avg(F.when(v.isNotNull(), (v > 1.0).cast("double"))).alias("__gt1"))
    j = df.crossJoin(F.broadcast(prof))
    mx, mn, gt1 = F.col("__mx"), F.col("__mn"), F.col("__gt1")
    fixed = (F.when(mx <= 1.0, v)
             .when((mx <= 100.0) & (gt1 >= 0.4), v / 100.0)
             .when(mx <= 100.0, v)
             .otherwise((v - mn) / F.greatest(mx - mn, F.lit(1e-9))))
    res = F.when(v.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fixed)))
    return j.withColumn(out, res).drop("__mx", "__mn", "__gt1")


def percent_aware(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Strip ``%``/``,``; if the column mean exceeds 1 divide by 100."""
    out = out or col
    v = sentinel_to_numeric(F.col(col), strip_percent=True)
    prof = df.agg(F.avg(v).alias("__mean"))
    j = df.crossJoin(F.broadcast(prof))
    return j.withColumn(out, F.when(F.col("__mean") > 1.0, v / 100.0).otherwise(v)).drop("__mean")


def minmax_normalise(df: DataFrame, col: str, out: str, invert: bool = False) -> DataFrame:
    """C17: batch min-max (``1 - x`` when ``invert``), denominator guarded by 1e-9."""
    prof = df.agg(F.min(col).alias("__mn"), F.max(col).alias("__mx"))
    j = df.crossJoin(F.broadcast(prof))
    z = (F.col(col) - F.col("__mn")) / (F.col("__mx") - F.col("__mn") + 1e-9)
    return j.withColumn(out, (1.0 - z) if invert else z).drop("__mn", "__mx")


def zscore_fallback_score(df: DataFrame, columns: Sequence[str], out: str = "derived_score") -> DataFrame:
    """Mean absolute z-score over the numeric columns, then min-max."""
    prof = df.agg(*[e for c in columns for e in (F.avg(c).alias(f"__mu_{c}"), F.stddev_samp(c).alias(f"__sd_{c}"))])
    j = df.crossJoin(F.broadcast(prof))
    zs = [F.coalesce(F.abs((F.col(c) - F.col(f"__mu_{c}")) / F.nullif(F.col(f"__sd_{c}"), F.lit(0.0))), F.lit(0.0))
          for c in columns]
    total = zs[0]
    for z in zs[1:]:
        total = total + z
    raw = j.withColumn("__raw", total / float(len(columns))).drop(*[c for c in j.columns if c.startswith("__mu_")
                                                                     or c.startswith("__sd_")])
    return minmax_normalise(raw, "__raw", out).drop("__raw")


def low_variance_columns(df: DataFrame, columns: Sequence[str], eps: float = 1e-12) -> list[str]:
    """Columns whose sample variance is NULL or <= eps (one aggregate)."""
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first().asDict()
    return [c for c in columns if row[c] is None or row[c] <= eps]


# ---------------------------------------------------------------------------
# C21 / full offline cleaning job
# ---------------------------------------------------------------------------
@dataclass
class CleaningReport:
    empty_columns: list[str] = field(default_factory=list)
    trace_columns: list[str] = field(default_factory=list)
    numeric_columns: list[str] = field(default_factory=list)
    categorical_columns: list[str] = field(default_factory=list)
    dropped_missing: list[str] = field(default_factory=list)
    n_rows: int = 0
    # filled for a report only: header pairs, rows left after each drop, and counts per value or column
    mapping: list[tuple[str, str]] = field(default_factory=list)
    leakage_columns: list[str] = field(default_factory=list)
    n_filled: int = 0
    n_distinct: int = 0
    target_counts: list[tuple[int, int]] = field(default_factory=list)
    missing: list[tuple[str, str]] = field(default_factory=list)
    impossible: list[tuple[str, int]] = field(default_factory=list)


def clean_table(df: DataFrame, key_cols: Sequence[str] = (), dedupe: bool = True,
                report: bool = False) -> tuple[DataFrame, DataFrame, CleaningReport]:
    """Offline cleaning order: rename -> drop empty -> dedup -> target ->
    trace/leakage split -> numeric typing -> missing drop -> impute ->
    impossible -> impute -> IQR clip -> mode fill.

    Returns ``(clean, trace, report)``; ``key_cols`` pass through untouched.
    With ``report`` the counts of every step are taken, too.
    """
    rep = CleaningReport()
    keys = list(key_cols)
    others = [c for c in df.columns if c not in keys]
    data_cols = H.suffix_duplicates([H.clean_header_offline(c) for c in others], reserved=keys)
    df = df.select(*keys, *others).toDF(*keys, *data_cols)
    df = df.na.drop(how="all", subset=data_cols)
    rep.mapping = list(zip(others, data_cols))
    if report:
        rep.n_filled = df.count()
    df, rep.empty_columns = drop_empty_columns(df)
    if dedupe:
        df = drop_duplicate_rows(df)
    if report:
        df = cut_lineage(df)  # counted before rows without a target go
        rep.n_distinct = df.count()
    df = drop_null_target(H.promote_target(df))
    # every later step (profile, three statistics passes, the final write)
    # reads this frame: materialise it once instead of repeating the
    # full-row dedupe shuffle in each pass
    df = cut_lineage(df)
    cand = [c for c in df.columns if c not in keys and c != "defect"]
    trace = H.keyword_trace_columns(cand)
    strings = [c for c in cand if c not in trace and dict(df.dtypes)[c] == "string"]
    prof = numeric_profile(df, strings)
    rep.n_rows = int(prof["__n"])
    trace += [c for c in strings if (prof[f"{c}__frac"] or 0.0) < config.TRACE_NUMERIC_FRACTION]
    trace_df = df.select(*keys, *trace, "defect")
    rep.leakage_columns = [c for c in df.columns if c in config.LEAKAGE_COLUMNS]
    df = H.drop_leakage(df)
    ml = [c for c in df.columns if c not in trace]
    numeric, categorical = [], []
    for c in ml:
        if c in keys or c == "defect":
            continue
        if dict(df.dtypes)[c] != "string":
            numeric.append(c)
        elif (prof.get(f"{c}__frac") or 0.0) >= config.NUMERIC_TYPE_FRACTION:
            numeric.append(c)
        else:
            categorical.append(c)
    typed = df.select(*[
        (sentinel_to_numeric(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")).alias(c)
        if c in numeric else F.col(c) for c in ml])
    n = max(rep.n_rows, 1)
    dropped = [c for c in numeric if c in strings and prof[f"{c}__miss"] / n > config.MISSING_DROP_FRACTION]
    rep.dropped_missing = dropped
    if report:
        counts = df.groupBy("defect").agg(F.count(F.lit(1)).alias("n")).orderBy("defect").collect()  # one row per class
        rep.target_counts = [(r["defect"], r["n"]) for r in counts]
        lost = missing_profile(typed, numeric).orderBy(F.desc("n_missing"), "column") if numeric else None
        rep.missing = [(r["column"], f"{r['n_missing']} ({r['pct_missing']:.1f}%)") for r in lost.collect()] if numeric else []
    numeric = [c for c in numeric if c not in dropped]
    typed = typed.drop(*dropped)
    x = impute_median(typed, numeric)
    if report and set(x.columns) & set(config.IMPOSSIBLE_RANGES):
        rep.impossible = [(r["column"], r["n_impossible"]) for r in impossible_counts(x).collect()]  # one row per column
    x = null_impossible(x)
    x = impute_median(x, numeric)
    x = clip_iqr(x, numeric)
    x = fill_mode(x, categorical)
    rep.trace_columns, rep.numeric_columns, rep.categorical_columns = trace, numeric, categorical
    return x, trace_df, rep


# FIXED VALUES - columns that stay text, and columns that charts expect
TEXT_COLUMNS = ["qa_summary", "recommendation", "risk_level", "anomaly_severity", "risk_factors"]
CHART_DEFAULTS = {"anomaly_score": 0.0, "defect_prob": 0.0, "pca_pc1": 0.0, "pca_pc2": 0.0}


def safe_frame(df: DataFrame, numeric_fraction: float = 0.25) -> DataFrame:
    """C21 analytics-safe frame: the first column of each name, text columns that are at least ``numeric_fraction``
    numeric typed, non-finite -> NULL -> median (0 where there is none), integer ``cluster``, chart columns present.

    Whole numbers without NULLs keep their type; with NULLs they become doubles, as their median may be one.
    An empty table keeps its typed columns and has no rows."""
    df = H.drop_duplicate_columns(df, cleaner=str)
    strings = [c for c, t in df.dtypes if t == "string" and c not in TEXT_COLUMNS]
    prof = numeric_profile(df, strings, strip_percent=True) if strings else {}
    typed = {c: sentinel_to_numeric(F.col(c), strip_percent=True) for c in strings
             if (prof.get(f"{c}__frac") or 0.0) >= numeric_fraction}
    df = df.withColumns(typed) if typed else df
    nums = [c for c in H.numeric_columns(df) if c != "cluster"]
    kinds = dict(df.dtypes)
    real = [c for c in nums if kinds[c] in ("double", "float")]
    whole = [c for c in nums if c not in real]
    df = non_finite_to_null(df, real) if real else df
    lost = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in whole]).first().asDict() if whole else {}
    fill = real + [c for c in whole if lost[c]]
    df = impute_median(df, fill).fillna(0.0, subset=fill) if fill else df
    if "cluster" in df.columns:
        cluster = sentinel_to_numeric(F.col("cluster")) if kinds["cluster"] == "string" else F.col("cluster").cast("double")
        df = df.withColumn("cluster", F.coalesce(finite_or_null(cluster).cast("int"), F.lit(0)))
    return H.ensure_columns(df, CHART_DEFAULTS)


# ---------------------------------------------------------------------------
# C23 row filters
# ---------------------------------------------------------------------------
def rows_with(df: DataFrame, col: str, choice: str) -> DataFrame:
    """Rows whose severity or risk level is the chosen one; all for ``ALL`` or without the column."""
    return df if choice == "ALL" or col not in df.columns else df.where(F.col(col).cast("string") == choice)


def high_risk_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("risk_level").isin("HIGH", "CRITICAL"))


def cluster_rows(df: DataFrame, cluster: int) -> DataFrame:
    """Batches of one cluster; none without the column."""
    return df.where(F.col("cluster") == cluster) if "cluster" in df.columns else df.where(F.lit(False))


def healthy_rows(df: DataFrame, label: str = "defect", prob: str = "defect_prob") -> DataFrame:
    """Batches without a defect (no label counts as none); else those with a probability below 0.5; else all.

    Which of the three holds is counted over the whole table and decided inside the plan, by a one-row join."""
    none = F.lit(False)
    sound = F.coalesce(F.col(label).try_cast("double").cast("int"), F.lit(0)) == 0 if label in df.columns else none
    likely = F.coalesce(F.col(prob).try_cast("double") < 0.5, none) if prob in df.columns else none
    found = df.agg(F.coalesce(F.bool_or(sound), none).alias("__sound"), F.coalesce(F.bool_or(likely), none).alias("__likely"))
    keep = F.when(F.col("__sound"), sound).when(F.col("__likely"), likely).otherwise(F.lit(True))
    return attach_scalar_row(df, found).where(keep).drop("__sound", "__likely")


def batch_label(df: DataFrame, candidates: Sequence[str], key: Column) -> Column:
    """First non-blank identifier, else ``Row <key>``."""
    parts = [F.when(F.length(F.trim(F.col(c).cast("string"))) > 0, F.col(c).cast("string"))
             for c in candidates if c in df.columns]
    return F.coalesce(*parts, F.concat(F.lit("Row "), key.cast("string")))


def typed_or_default(df: DataFrame, col: str, default: float) -> Column:
    """Null-safe numeric access with a default."""
    if col not in df.columns:
        return F.lit(float(default))
    c = F.col(col)
    conv = sentinel_to_numeric(c) if dict(df.dtypes)[col] == "string" else c.cast("double")
    return F.coalesce(finite_or_null(conv), F.lit(float(default)))
