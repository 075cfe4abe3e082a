"""Cleaning (C*) entries over ``heats_raw`` / ``heats``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import clamp01_scalar, sentinel_to_numeric, severity_from_score
from ..operators import cleaning as C
from ..operators import decisions as D
from ..plans.registry import register
from ..sources.fixtures import HEAT_KEY, heats, heats_raw, with_fixtures
from .sqlparts import KEY, decided_sql

_RX = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def num_sql(x: str, strip: bool = False) -> str:
    s = f"trim({x})" if not strip else f"trim(regexp_replace(trim({x}), '[,%]', '', 'g'))"
    sent = ", ".join(f"'{v}'" for v in config.NULL_SENTINELS)
    return (f"(case when {x} is null or lower({s}) in ({sent}) or not regexp_full_match({s}, '{_RX}') "
            f"then null else cast({s} as double) end)")


_TYPED = f"""select {KEY}, cast({num_sql('defected')} as int) as defect,
  {num_sql('tapping_temp')} as tapping_temp, {num_sql('pouring_temp')} as pouring_temp, mg_recovery
from heats_raw"""

CLEAN_SQL = with_fixtures(f"""select {KEY}, defect, mg_recovery,
  greatest(least(tapping_temp, q3t + 3e0*(q3t - q1t)), q1t - 3e0*(q3t - q1t)) as tapping_temp,
  greatest(least(pouring_temp, q3p + 3e0*(q3p - q1p)), q1p - 3e0*(q3p - q1p)) as pouring_temp
from i2, q""", "heats_raw", ctes={
    "t": f"select * from ({_TYPED}) where defect is not null",
    "m1": "select median(tapping_temp) as mt, median(pouring_temp) as mp from t",
    "i1": f"select {KEY}, defect, mg_recovery, coalesce(tapping_temp, mt) as tapping_temp, "
          "coalesce(pouring_temp, mp) as pouring_temp from t, m1",
    "n1": f"select {KEY}, defect, mg_recovery, "
          "case when tapping_temp < 1.2e3 or tapping_temp > 1.6e3 then null else tapping_temp end as tapping_temp, "
          "case when pouring_temp < 1.2e3 or pouring_temp > 1.6e3 then null else pouring_temp end as pouring_temp "
          "from i1",
    "m2": "select median(tapping_temp) as mt, median(pouring_temp) as mp from n1",
    "i2": f"select {KEY}, defect, mg_recovery, coalesce(tapping_temp, mt) as tapping_temp, "
          "coalesce(pouring_temp, mp) as pouring_temp from n1, m2",
    "q": "select quantile_cont(tapping_temp, 2.5e-1) as q1t, quantile_cont(tapping_temp, 7.5e-1) as q3t, "
         "quantile_cont(pouring_temp, 2.5e-1) as q1p, quantile_cont(pouring_temp, 7.5e-1) as q3p from i2",
})


@register("c21_clean_heats_raw", CLEAN_SQL)
def c21_clean_heats_raw(spark, sf_dir):
    clean, _trace, _rep = C.clean_table(heats_raw(spark, sf_dir), key_cols=HEAT_KEY)
    return clean


@register("c1_drop_empty_columns", with_fixtures(
    "select 'empty_col' as dropped_column", "heats_raw"))
def c1_drop_empty_columns(spark, sf_dir):
    _df, empty = C.drop_empty_columns(heats_raw(spark, sf_dir))
    return spark.createDataFrame([(c,) for c in empty], "dropped_column string")


@register("c2_dedupe_rows", with_fixtures(
    """select count(*) as n_rows, cast(sum(n - 1) as bigint) as n_removed, count(*) filter (where furnace is null) as n_null_furnace from (
      select l_partkey % 50 as p, l_suppkey, tapping_temp, pouring_temp, mg_recovery, furnace, empty_col, defected, count(*) as n from heats_raw
      group by all)""", "heats_raw"))
def c2_dedupe_rows(spark, sf_dir):
    """Whole raw rows without their keys (which make them unique), NULLs included: kept rows and removed copies."""
    raw = heats_raw(spark, sf_dir)
    rows = raw.select((F.col("l_partkey") % 50).alias("p"), "l_suppkey", *[c for c in raw.columns if c not in HEAT_KEY])
    return C.count_duplicate_rows(rows).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("n_copies") - 1).alias("n_removed"),
                                            F.count_if(F.col("furnace").isNull()).alias("n_null_furnace"))


@register("c3_drop_null_target", with_fixtures(
    f"select count(*) as n_rows from ({_TYPED}) where defect is not null", "heats_raw"))
def c3_drop_null_target(spark, sf_dir):
    from ..operators.schema import promote_target
    df = C.drop_null_target(promote_target(heats_raw(spark, sf_dir), "defected"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


@register("c4_sentinel_numeric", with_fixtures(
    f"select {KEY}, {num_sql('tapping_temp')} as tapping_temp, {num_sql('pouring_temp')} as pouring_temp "
    "from heats_raw", "heats_raw"))
def c4_sentinel_numeric(spark, sf_dir):
    h = heats_raw(spark, sf_dir)
    return h.select(*HEAT_KEY, sentinel_to_numeric(F.col("tapping_temp")).alias("tapping_temp"),
                    sentinel_to_numeric(F.col("pouring_temp")).alias("pouring_temp"))


@register("c5_strip_percent_numeric", with_fixtures(
    f"select {KEY}, {num_sql('mg_recovery', strip=True)} as mg_recovery from heats_raw", "heats_raw"))
def c5_strip_percent_numeric(spark, sf_dir):
    h = heats_raw(spark, sf_dir)
    return h.select(*HEAT_KEY, sentinel_to_numeric(F.col("mg_recovery"), strip_percent=True).alias("mg_recovery"))


_FRAC_SQL = " union all ".join(
    f"select '{c}' as column_name, round(avg(case when {num_sql(c)} is not null then 1e0 else 0e0 end), 9) as numeric_fraction, "
    f"case when avg(case when {num_sql(c)} is not null then 1e0 else 0e0 end) < 2e-1 then 'trace' "
    f"when avg(case when {num_sql(c)} is not null then 1e0 else 0e0 end) >= 3e-1 then 'numeric' else 'categorical' end as decided_type "
    f"from heats_raw where {num_sql('defected')} is not null"
    for c in ["tapping_temp", "pouring_temp", "mg_recovery", "furnace"])


@register("c6_type_decision", with_fixtures(_FRAC_SQL, "heats_raw"))
def c6_type_decision(spark, sf_dir):
    from ..operators.schema import promote_target
    df = C.drop_null_target(promote_target(heats_raw(spark, sf_dir), "defected"))
    cols = ["tapping_temp", "pouring_temp", "mg_recovery", "furnace"]
    prof = df.agg(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                     F.avg(sentinel_to_numeric(F.col(c)).isNotNull().cast("double")).alias("f"))
                            for c in cols]).alias("a"))
    x = prof.select(F.explode("a").alias("x")).select("x.column_name", "x.f")
    return x.select("column_name", F.round("f", 9).alias("numeric_fraction"),
                    F.when(F.col("f") < config.TRACE_NUMERIC_FRACTION, "trace")
                    .when(F.col("f") >= config.NUMERIC_TYPE_FRACTION, "numeric").otherwise("categorical")
                    .alias("decided_type"))


@register("c7_missing_profile", with_fixtures(
    " union all ".join(
        f"select '{c}' as column, count(*) filter (where {c} is null) as n_missing, "
        f"round(count(*) filter (where {c} is null) * 1e2 / count(*), 6) as pct_missing from t"
        for c in ["tapping_temp", "pouring_temp", "furnace", "empty_col"]) ,
    "heats_raw", ctes={"t": f"select {num_sql('tapping_temp')} as tapping_temp, {num_sql('pouring_temp')} as "
                            "pouring_temp, furnace, empty_col from heats_raw"}).replace(
    "union all", "union all") + "")
def c7_missing_profile(spark, sf_dir):
    h = heats_raw(spark, sf_dir)
    t = h.select(sentinel_to_numeric(F.col("tapping_temp")).alias("tapping_temp"),
                 sentinel_to_numeric(F.col("pouring_temp")).alias("pouring_temp"), "furnace", "empty_col")
    return C.missing_profile(t, ["tapping_temp", "pouring_temp", "furnace", "empty_col"])


@register("c8_median_impute", with_fixtures(
    f"select {KEY}, coalesce(tapping_temp, (select median(tapping_temp) from t)) as tapping_temp from t",
    "heats_raw", ctes={"t": f"select {KEY}, {num_sql('tapping_temp')} as tapping_temp from heats_raw"}))
def c8_median_impute(spark, sf_dir):
    h = heats_raw(spark, sf_dir)
    t = h.select(*HEAT_KEY, sentinel_to_numeric(F.col("tapping_temp")).alias("tapping_temp"))
    return C.impute_median(t, ["tapping_temp"])


@register("c9_training_median_fill", with_fixtures(
    f"select {KEY}, coalesce({num_sql('tapping_temp')}, 1.4e3) as tapping_temp from heats_raw", "heats_raw"))
def c9_training_median_fill(spark, sf_dir):
    h = heats_raw(spark, sf_dir)
    t = h.select(*HEAT_KEY, sentinel_to_numeric(F.col("tapping_temp")).alias("tapping_temp"))
    return C.impute_median(t, ["tapping_temp"], medians={"tapping_temp": 1400.0})


@register("c10_impossible_values", with_fixtures(
    "select 'tapping_temp' as column, 1.2e3 as lo, 1.6e3 as hi, count(*) filter (where tapping_temp < 1.2e3 or "
    "tapping_temp > 1.6e3) as n_impossible from t union all select 'pouring_temp', 1.2e3, 1.6e3, count(*) filter "
    "(where pouring_temp < 1.2e3 or pouring_temp > 1.6e3) from t", "heats_raw",
    ctes={"t": f"select {num_sql('tapping_temp')} as tapping_temp, {num_sql('pouring_temp')} as pouring_temp "
               "from heats_raw"}))
def c10_impossible_values(spark, sf_dir):
    h = heats_raw(spark, sf_dir)
    t = h.select(sentinel_to_numeric(F.col("tapping_temp")).alias("tapping_temp"),
                 sentinel_to_numeric(F.col("pouring_temp")).alias("pouring_temp"))
    return C.impossible_counts(t)


@register("c11_iqr_clip", with_fixtures(
    f"""select {KEY}, case when pouring_temp is null then null else
          greatest(least(pouring_temp, q3 + 3e0*(q3-q1)), q1 - 3e0*(q3-q1)) end as pouring_temp from t,
        (select quantile_cont(pouring_temp, 2.5e-1) as q1, quantile_cont(pouring_temp, 7.5e-1) as q3 from t) q""",
    "heats_raw", ctes={"t": f"select {KEY}, {num_sql('pouring_temp')} as pouring_temp from heats_raw"}))
def c11_iqr_clip(spark, sf_dir):
    h = heats_raw(spark, sf_dir)
    t = h.select(*HEAT_KEY, sentinel_to_numeric(F.col("pouring_temp")).alias("pouring_temp"))
    return C.clip_iqr(t, ["pouring_temp"])


@register("c12_mode_fill", with_fixtures(
    f"""select {KEY}, coalesce(furnace, (select furnace from heats_raw where furnace is not null
        group by furnace order by count(*) desc, furnace asc limit 1), 'UNKNOWN') as furnace from heats_raw""",
    "heats_raw"))
def c12_mode_fill(spark, sf_dir):
    return C.fill_mode(heats_raw(spark, sf_dir).select(*HEAT_KEY, "furnace"), ["furnace"])


@register("c13_non_finite_to_null", with_fixtures(
    f"select {KEY}, case when tapped_wt_ <> 0e0 then heel / tapped_wt_ end as heel_ratio from heats", "heats"))
def c13_non_finite_to_null(spark, sf_dir):
    h = heats(spark, sf_dir)
    x = h.select(*HEAT_KEY, F.when(F.col("tapped_wt_") == 0, F.lit(float("inf")))
                 .otherwise(F.col("heel") / F.col("tapped_wt_")).alias("heel_ratio"))
    return C.non_finite_to_null(x, ["heel_ratio"])


@register("c14_unit_interval_profile", with_fixtures(
    f"""select {KEY}, case when v is null then 0e0 else greatest(0e0, least(1e0, case when mx <= 1e0 then v
         when mx <= 1e2 and gt1 >= 4e-1 then v / 1e2 when mx <= 1e2 then v
         else (v - mn) / greatest(mx - mn, 1e-9) end)) end as prob_fixed
        from (select {KEY}, defect_prob * 1e2 as v from heats) t,
        (select max(defect_prob * 1e2) as mx, min(defect_prob * 1e2) as mn,
                avg(case when defect_prob * 1e2 > 1e0 then 1e0 else 0e0 end) as gt1 from heats) p""", "heats"))
def c14_unit_interval_profile(spark, sf_dir):
    h = heats(spark, sf_dir).select(*HEAT_KEY, (F.col("defect_prob") * 100.0).alias("v"))
    return C.unit_interval_by_profile(h, "v", "prob_fixed").select(*HEAT_KEY, "prob_fixed")


@register("c15_unit_interval_value", with_fixtures(
    f"""select {KEY}, greatest(0e0, least(1e0, case when v > 1e0 then (case when v <= 1e2 then v / 1e2 else 1e0 end)
        else v end)) as prob_fixed from (select {KEY}, defect_prob * 1.5e2 as v from heats) t""", "heats"))
def c15_unit_interval_value(spark, sf_dir):
    h = heats(spark, sf_dir)
    return h.select(*HEAT_KEY, clamp01_scalar(F.col("defect_prob") * 150.0).alias("prob_fixed"))


@register("c16_percent_aware_mg", with_fixtures(
    f"""select {KEY}, case when m > 1e0 then v / 1e2 else v end as mg_recovery from
        (select {KEY}, {num_sql('mg_recovery', strip=True)} as v from heats_raw) t,
        (select avg({num_sql('mg_recovery', strip=True)}) as m from heats_raw) a""", "heats_raw"))
def c16_percent_aware_mg(spark, sf_dir):
    h = heats_raw(spark, sf_dir).select(*HEAT_KEY, "mg_recovery")
    return C.percent_aware(h, "mg_recovery")


@register("c17_minmax_normalise", with_fixtures(
    f"""select {KEY}, round((anomaly_score - mn) / (mx - mn + 1e-9), 12) as norm_score,
        round(1e0 - (anomaly_score - mn) / (mx - mn + 1e-9), 12) as inv_score
        from heats, (select min(anomaly_score) as mn, max(anomaly_score) as mx from heats) s""", "heats"))
def c17_minmax_normalise(spark, sf_dir):
    h = heats(spark, sf_dir).select(*HEAT_KEY, "anomaly_score")
    a = C.minmax_normalise(h, "anomaly_score", "norm_score")
    b = C.minmax_normalise(a, "anomaly_score", "inv_score", invert=True)
    return b.select(*HEAT_KEY, F.round("norm_score", 12).alias("norm_score"),
                    F.round("inv_score", 12).alias("inv_score"))


@register("c19_normalize_recommendation", decided_sql(
    "select upper(trim(lower(recommendation))) as recommendation, count(*) as n_batches from final group by 1"))
def c19_normalize_recommendation(spark, sf_dir):
    from .core import decided
    d = decided(spark, sf_dir).select(F.concat(F.lit("  "), F.lower("recommendation")).alias("r"))
    return d.groupBy(D.normalize_recommendation(F.col("r")).alias("recommendation")) \
        .agg(F.count(F.lit(1)).alias("n_batches"))


@register("c20_risk_display_bucket", decided_sql(
    """select case when upper(trim(risk_level)) in ('NORMAL','OK','PASS','ACCEPT','ACCEPTABLE','NONE','NAN')
         then 'HEALTHY' when upper(trim(risk_level)) in ('HEALTHY','LOW','MEDIUM','HIGH','CRITICAL')
         then upper(trim(risk_level)) else 'LOW' end as risk_bucket, count(*) as n_batches from final group by 1"""))
def c20_risk_display_bucket(spark, sf_dir):
    from .core import decided
    d = decided(spark, sf_dir)
    return d.groupBy(D.risk_display_bucket(F.col("risk_level")).alias("risk_bucket")) \
        .agg(F.count(F.lit(1)).alias("n_batches"))


@register("c22_low_variance_columns", with_fixtures(
    " union all ".join(f"select '{c}' as column_name from heats having coalesce(var_samp({c}), 0e0) <= 1e-12"
                       for c in ["c_", "si_", "s_", "tapped_wt_", "defect_prob"])
    + " union all select 'const_one' as column_name", "heats"))
def c22_low_variance_columns(spark, sf_dir):
    h = heats(spark, sf_dir).withColumn("const_one", F.lit(1.0))
    cols = ["c_", "si_", "s_", "tapped_wt_", "defect_prob", "const_one"]
    low = C.low_variance_columns(h, cols)
    return spark.createDataFrame([(c,) for c in low], "column_name string")


@register("c23_severity_filter", with_fixtures(
    """select count(*) as n_batches from heats where anomaly_score >= 6e-1""", "heats"))
def c23_severity_filter(spark, sf_dir):
    h = heats(spark, sf_dir)
    sev = severity_from_score(F.col("anomaly_score"))
    return h.where(sev.isin("HIGH RISK", "CRITICAL")).agg(F.count(F.lit(1)).alias("n_batches"))


_HEALTHY = "select * from final where defect = 1"


@register("c23_row_filters", decided_sql(
    "select name, count(*) as n_batches, cast(sum(l_orderkey) as bigint) as key_sum from ("
    "select 'all' as name, l_orderkey from final union all "
    "select 'severity CRITICAL', l_orderkey from final where anomaly_score >= 8e-1 union all "
    "select 'risk HIGH', l_orderkey from final where risk_level = 'HIGH' union all "
    "select 'high or critical', l_orderkey from final where risk_level in ('HIGH', 'CRITICAL') union all "
    "select 'cluster 2', l_orderkey from final where cluster = 2 union all "
    "select 'healthy by label', l_orderkey from final where defect = 0 union all "
    f"select 'healthy by probability', l_orderkey from ({_HEALTHY}) where defect_prob < 5e-1 union all "
    f"select 'healthy unknown', l_orderkey from ({_HEALTHY}) where defect_prob >= 5e-1) group by name"))
def c23_row_filters(spark, sf_dir):
    """Every row filter; the healthy subset on a fleet with sound batches, one without, and one without likely ones either."""
    d = decided_rows(spark, sf_dir)
    bad = d.where("defect = 1")
    frames = {"all": C.rows_with(d, "risk_level", "ALL"), "severity CRITICAL": C.rows_with(d, "anomaly_severity", "CRITICAL"),
              "risk HIGH": C.rows_with(d, "risk_level", "HIGH"), "high or critical": C.high_risk_rows(d), "cluster 2": C.cluster_rows(d, 2),
              "healthy by label": C.healthy_rows(d), "healthy by probability": C.healthy_rows(bad),
              "healthy unknown": C.healthy_rows(bad.where("defect_prob >= 5e-1"))}
    out = None
    for name, df in frames.items():
        part = df.agg(F.count(F.lit(1)).alias("n_batches"), F.sum("l_orderkey").alias("key_sum")).select(F.lit(name).alias("name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def decided_rows(spark, sf_dir):
    """Decided batches with their severities, stored once for the filters."""
    from ..operators.analytics import with_severity
    from ..sources import io as IO
    from .core import decided
    path = IO.scratch_path(spark, "decided")
    d = with_severity(decided(spark, sf_dir)).select("l_orderkey", "defect", "cluster", "defect_prob", "anomaly_severity", "risk_level")
    return spark.read.parquet(IO.write_table(d, path))


@register("c21_safe_frame", with_fixtures(
    f"select {KEY}, furnace, empty_col, coalesce(t, (select median(t) from n), 0e0) as tapping_temp, "
    "coalesce(p, (select median(p) from n), 0e0) as pouring_temp, coalesce(m, (select median(m) from n), 0e0) as mg_recovery, "
    "coalesce(d, (select median(d) from n), 0e0) as defected, coalesce(cast(cl as int), 0) as cluster, 0e0 as anomaly_score, "
    "0e0 as defect_prob, 0e0 as pca_pc1, 0e0 as pca_pc2 from n", "heats_raw", ctes={
        "n": f"select *, {num_sql('tapping_temp', True)} as t, {num_sql('pouring_temp', True)} as p, {num_sql('mg_recovery', True)} as m, "
             f"{num_sql('defected', True)} as d, case when l_linenumber = 7 then null else l_linenumber end as cl from heats_raw"}))
def c21_safe_frame(spark, sf_dir):
    """The online frame cleaner on raw rows with a repeated column and clusters that are partly unknown."""
    raw = heats_raw(spark, sf_dir).withColumn("cluster", F.when(F.col("l_linenumber") != 7, F.col("l_linenumber").cast("double")))
    return C.safe_frame(raw.select("*", F.lit("second").alias("furnace")))


@register("c24_batch_label", with_fixtures(
    f"select {KEY}, coalesce(case when length(trim(furnace)) > 0 then furnace end, "
    "'Row ' || cast(l_orderkey as varchar)) as batch_label from heats_raw", "heats_raw"))
def c24_batch_label(spark, sf_dir):
    h = heats_raw(spark, sf_dir)
    return h.select(*HEAT_KEY, C.batch_label(h, ["furnace"], F.col("l_orderkey")).alias("batch_label"))


@register("c25_typed_default", with_fixtures(
    f"select {KEY}, coalesce({num_sql('pouring_temp')}, -1e0) as pouring_temp, -1e0 as missing_col "
    "from heats_raw", "heats_raw"))
def c25_typed_default(spark, sf_dir):
    h = heats_raw(spark, sf_dir)
    return h.select(*HEAT_KEY, C.typed_or_default(h, "pouring_temp", -1.0).alias("pouring_temp"),
                    C.typed_or_default(h, "missing_col", -1.0).alias("missing_col"))
