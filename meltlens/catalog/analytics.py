"""Fleet analytics (A*), windows / top-k (W*) and lookups (J*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import clamp01_scalar, label_of, rank_of, severity_from_score, severity_rank
from ..operators import analytics as AN
from ..operators import decisions as D
from ..operators import evaluation as EV
from ..operators import windows as W
from ..plans.ordered import attach_by_position
from ..plans.registry import register
from ..sources.fixtures import HEAT_KEY, heat_events, heats, with_fixtures
from .core import decided, featured
from .sqlparts import KEY, decided_sql, features_sql

R9 = 9  # rounding of floating aggregates (summation order differs between engines)


def _r(c, n=R9):
    return F.round(c, n)


DRIVER_COLS = ["c_", "si_", "s_", "mn_", "p__", "cr_", "mg_", "n__", "al__", "feat_chemistry_instability",
               "feat_temp_loss", "feat_shrinkage_risk_index", "feat_gas_risk_index", "tapping_temp",
               "pouring_temp", "mg_recovery_"]

_SEV_SQL = ("case when anomaly_score >= 8e-1 then 'CRITICAL' when anomaly_score >= 6e-1 then 'HIGH RISK' "
            "when anomaly_score >= 4e-1 then 'MEDIUM RISK' when anomaly_score >= 2e-1 then 'LOW RISK' else 'NORMAL' end")


@register("a1_target_distribution", with_fixtures("select defect, count(*) as n from heats group by defect", "heats"))
def a1_target_distribution(spark, sf_dir):
    return AN.value_counts(heats(spark, sf_dir), "defect")


@register("a2_kpi_summary", features_sql(
    """select count(*) as total_batches, sum(defect) as defective_batches,
       count(*) filter (where defect = 0) as healthy_batches, round(avg(defect), 9) as defect_rate,
       round(avg(s_), 9) as avg_sulfur, max(s_) as max_sulfur, count(*) filter (where s_ > 1.5e-2) as high_sulfur_n,
       round(avg(mg_recovery_), 9) as avg_mg_recovery, count(*) filter (where mg_recovery_ < 4e-1) as low_mg_n,
       round(avg(feat_temp_loss), 9) as avg_temp_loss, count(*) filter (where feat_temp_loss > 8e1) as high_loss_n,
       sum(case when anomaly_score >= 6e-1 then 1 else 0 end) as anomalies,
       round(avg(case when anomaly_score >= 6e-1 then 1e0 else 0e0 end), 9) as anomaly_rate from feat"""))
def a2_kpi_summary(spark, sf_dir):
    f = AN.with_severity(featured(spark, sf_dir))
    return f.agg(
        F.count(F.lit(1)).alias("total_batches"), F.sum("defect").alias("defective_batches"),
        F.count_if(F.col("defect") == 0).alias("healthy_batches"), _r(F.avg("defect")).alias("defect_rate"),
        _r(F.avg("s_")).alias("avg_sulfur"), F.max("s_").alias("max_sulfur"),
        F.count_if(F.col("s_") > 0.015).alias("high_sulfur_n"),
        _r(F.avg("mg_recovery_")).alias("avg_mg_recovery"), F.count_if(F.col("mg_recovery_") < 0.40).alias("low_mg_n"),
        _r(F.avg("feat_temp_loss")).alias("avg_temp_loss"), F.count_if(F.col("feat_temp_loss") > 80).alias("high_loss_n"),
        F.sum("anomaly_flag").alias("anomalies"), _r(F.avg(F.col("anomaly_flag").cast("double"))).alias("anomaly_rate"))


@register("a3_severity_distribution", with_fixtures(
    f"""select 'severity' as item, {_SEV_SQL} as name, cast(null as int) as flag, cast(count(*) as double) as value
        from heats group by {_SEV_SQL}
        union all select 'flag_rate', 'all', null, round(avg(case when anomaly_score >= 6e-1 then 1e0 else 0e0 end), 9) from heats
        union all select 'defect', cast(defect as varchar), case when anomaly_score >= 6e-1 then 1 else 0 end,
                         cast(count(*) as double) from heats group by 2, 3""", "heats"))
def a3_severity_distribution(spark, sf_dir):
    """Severity counts, the anomaly flag rate and the defect x flag crosstab as long rows."""
    h = AN.with_severity(heats(spark, sf_dir))
    none = F.lit(None).cast("int")
    counts = h.groupBy(F.col("anomaly_severity").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    rate = h.agg(_r(F.avg(F.col("anomaly_flag").cast("double"))).alias("value"))
    cross = h.groupBy(F.col("defect").cast("string").alias("name"), F.col("anomaly_flag").alias("flag")).agg(
        F.count(F.lit(1)).cast("double").alias("value"))
    return (counts.select(F.lit("severity").alias("item"), "name", none.alias("flag"), "value")
            .unionByName(rate.select(F.lit("flag_rate").alias("item"), F.lit("all").alias("name"), none.alias("flag"), "value"))
            .unionByName(cross.select(F.lit("defect").alias("item"), "name", "flag", "value")))


@register("a4_cluster_stats", with_fixtures(
    "select cluster, count(*) as batch_count, round(avg(defect), 9) as defect_rate from heats group by cluster",
    "heats"))
def a4_cluster_stats(spark, sf_dir):
    return heats(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("batch_count"),
                                                      _r(F.avg("defect")).alias("defect_rate"))


_PROFILE_VARS = ["c_", "si_", "s_", "mn_", "mg_recovery_", "tapping_temp", "pouring_temp", "feat_temp_loss",
                 "feat_ce_calculated", "feat_chemistry_instability", "anomaly_score"]


@register("a5_cluster_profile", features_sql(
    "select cluster, " + ", ".join(f"round(avg({c}), 4) as {c}" for c in _PROFILE_VARS)
    + ", round(avg(defect), 4) as defect_rate, count(*) as batch_count from feat group by cluster"))
def a5_cluster_profile(spark, sf_dir):
    f = featured(spark, sf_dir)
    return f.groupBy("cluster").agg(*[F.round(F.avg(c), 4).alias(c) for c in _PROFILE_VARS],
                                    F.round(F.avg("defect"), 4).alias("defect_rate"),
                                    F.count(F.lit(1)).alias("batch_count"))


# FIXED VALUES — cluster narrative texts
_A6_TXT = {
    "s_high": "High sulfur → nodularisation risk",
    "s_ok": "Sulfur within acceptable range",
    "mg_low": "Low Mg recovery → unstable nodularisation",
    "loss": "High temperature loss → cold pour risk",
    "shrink": "Elevated shrinkage risk index",
    "chem": "Chemistry deviation from target",
    "nominal": "Nominal process behaviour",
}


@register("a6_cluster_interpretation", features_sql(
    f"""select cluster, coalesce(nullif(concat_ws('; ',
         printf('Defect rate: %.1f%%', dr * 1e2),
         case when s > 1.5e-2 then '{_A6_TXT["s_high"]}' else '{_A6_TXT["s_ok"]}' end,
         case when mg < 3e-1 then '{_A6_TXT["mg_low"]}' end,
         case when tl > 7e1 then '{_A6_TXT["loss"]}' end,
         case when sh > 2e0 then '{_A6_TXT["shrink"]}' end,
         case when ch > 2e-1 then '{_A6_TXT["chem"]}' end), ''), '{_A6_TXT["nominal"]}') as interpretation
       from (select cluster, round(avg(defect), 4) as dr, round(avg(s_), 4) as s, round(avg(mg_recovery_), 4) as mg,
               round(avg(feat_temp_loss), 4) as tl, round(avg(feat_shrinkage_risk_index), 4) as sh,
               round(avg(feat_chemistry_instability), 4) as ch from feat group by cluster)"""))
def a6_cluster_interpretation(spark, sf_dir):
    """Narrative per cluster from the 4-decimal profile (A5)."""
    from ..functions.text import fmt
    f = featured(spark, sf_dir)
    p = f.groupBy("cluster").agg(*[F.round(F.avg(c), 4).alias(n) for c, n in (
        ("defect", "dr"), ("s_", "s"), ("mg_recovery_", "mg"), ("feat_temp_loss", "tl"),
        ("feat_shrinkage_risk_index", "sh"), ("feat_chemistry_instability", "ch"))])
    parts = F.concat_ws(
        "; ",
        fmt("Defect rate: %.1f%%", F.col("dr") * 100.0),
        F.when(F.col("s") > 0.015, F.lit(_A6_TXT["s_high"])).otherwise(F.lit(_A6_TXT["s_ok"])),
        F.when(F.col("mg") < 0.3, F.lit(_A6_TXT["mg_low"])),
        F.when(F.col("tl") > 70, F.lit(_A6_TXT["loss"])),
        F.when(F.col("sh") > 2, F.lit(_A6_TXT["shrink"])),
        F.when(F.col("ch") > 0.2, F.lit(_A6_TXT["chem"])))
    txt = F.coalesce(F.nullif(parts, F.lit("")), F.lit(_A6_TXT["nominal"]))
    return p.select("cluster", txt.alias("interpretation"))


# FIXED VALUES — cluster signature texts
_A8_TXT = {
    "tend_high": "Historically elevated defect rate — prioritize HOLD review",
    "tend_mid": "Moderate defect tendency — monitor chemistry and temperature",
    "tend_low": "Typical defect exposure for this operating mode",
    "sig_default": "Standard production mix",
    "sig_stable": "High temperature stable production cluster",
    "sig_loss": "High ladle heat-loss / extended transfer cluster",
    "sig_chem": "Chemistry drift / out-of-spec cluster",
    "sig_anom": "Anomalous process signature — rare operating point",
}


@register("a8_cluster_signature", features_sql(
    f"""select cluster,
         case when r >= 3.5e-1 then 'High-Risk Cluster ' || cluster when r >= 2e-1 then 'Elevated-Risk Cluster ' || cluster
              else 'Cluster ' || cluster end as name,
         case when an > 5.5e-1 then '{_A8_TXT["sig_anom"]}' when ci > 5e-1 then '{_A8_TXT["sig_chem"]}'
              when n >= 2 and sd < 1.5e1 then '{_A8_TXT["sig_stable"]}'
              when n >= 2 and l > 7e1 then '{_A8_TXT["sig_loss"]}' else '{_A8_TXT["sig_default"]}' end as signature,
         case when r >= 3.5e-1 then '{_A8_TXT["tend_high"]}' when r >= 2e-1 then '{_A8_TXT["tend_mid"]}'
              else '{_A8_TXT["tend_low"]}' end as tendency,
         round(r, 9) as defect_rate, n as batch_count, round(p, 9) as avg_defect_prob, round(an, 9) as avg_anomaly
       from (select cluster, avg(cast(coalesce(defect, 0) as double)) as r, count(*) as n, stddev_samp(pouring_temp) as sd,
               avg(feat_temp_loss) as l, avg(feat_chemistry_instability) as ci, avg(anomaly_score) as an,
               avg(defect_prob) as p from feat where cluster is not null group by cluster)"""))
def a8_cluster_signature(spark, sf_dir):
    """Name / signature / tendency per cluster, all clusters in one aggregate."""
    f = featured(spark, sf_dir)
    g = f.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(
        F.avg(F.coalesce(F.col("defect"), F.lit(0)).cast("double")).alias("r"), F.count(F.lit(1)).alias("n"),
        F.stddev_samp("pouring_temp").alias("sd"), F.avg("feat_temp_loss").alias("l"),
        F.avg("feat_chemistry_instability").alias("ci"), F.avg("anomaly_score").alias("an"),
        F.avg("defect_prob").alias("p"))
    r, c = F.col("r"), F.col("cluster").cast("string")
    name = (F.when(r >= 0.35, F.concat(F.lit("High-Risk Cluster "), c))
            .when(r >= 0.20, F.concat(F.lit("Elevated-Risk Cluster "), c)).otherwise(F.concat(F.lit("Cluster "), c)))
    sig = (F.when(F.col("an") > 0.55, F.lit(_A8_TXT["sig_anom"]))
           .when(F.col("ci") > 0.5, F.lit(_A8_TXT["sig_chem"]))
           .when((F.col("n") >= 2) & (F.col("sd") < 15), F.lit(_A8_TXT["sig_stable"]))
           .when((F.col("n") >= 2) & (F.col("l") > 70), F.lit(_A8_TXT["sig_loss"]))
           .otherwise(F.lit(_A8_TXT["sig_default"])))
    tend = (F.when(r >= 0.35, F.lit(_A8_TXT["tend_high"])).when(r >= 0.20, F.lit(_A8_TXT["tend_mid"]))
            .otherwise(F.lit(_A8_TXT["tend_low"])))
    return g.select("cluster", name.alias("name"), sig.alias("signature"), tend.alias("tendency"),
                    _r(r).alias("defect_rate"), F.col("n").alias("batch_count"), _r(F.col("p")).alias("avg_defect_prob"),
                    _r(F.col("an")).alias("avg_anomaly"))


@register("a9_defect_anomaly_crosstab", with_fixtures(
    """select defect, count(*) filter (where anomaly_score < 6e-1) as flag_0,
         count(*) filter (where anomaly_score >= 6e-1) as flag_1 from heats group by defect""", "heats"))
def a9_defect_anomaly_crosstab(spark, sf_dir):
    h = AN.with_severity(heats(spark, sf_dir))
    return h.groupBy("defect").pivot("anomaly_flag", [0, 1]).count().na.fill(0) \
        .withColumnsRenamed({"0": "flag_0", "1": "flag_1"})


_RISK_BUCKETS = config.RISK_DISPLAY_ORDER
_RECS = config.RECOMMENDATION_ORDER


@register("a10_risk_recommendation_crosstab", decided_sql(
    "select b.risk_bucket, " + ", ".join(
        f"coalesce(sum(case when f.recommendation = '{r}' then 1 else 0 end), 0) as {r.lower()}" for r in _RECS)
    + " from (values " + ", ".join(f"('{b}')" for b in _RISK_BUCKETS) + ") b(risk_bucket) "
    "left join final f on f.risk_level = b.risk_bucket group by b.risk_bucket"))
def a10_risk_recommendation_crosstab(spark, sf_dir):
    d = decided(spark, sf_dir).select(D.risk_display_bucket(F.col("risk_level")).alias("risk_bucket"),
                                      "recommendation")
    piv = d.groupBy("risk_bucket").pivot("recommendation", _RECS).count()
    dim = spark.createDataFrame([(b,) for b in _RISK_BUCKETS], "risk_bucket string")  # fixed 5 rows
    out = dim.join(piv, "risk_bucket", "left").na.fill(0, subset=_RECS)
    return out.select("risk_bucket", *[F.col(r).cast("long").alias(r.lower()) for r in _RECS])


@register("a11_risk_recommendation_counts", decided_sql(
    "select risk_level, recommendation, count(*) as n from final group by 1, 2"))
def a11_risk_recommendation_counts(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("risk_level", "recommendation").agg(F.count(F.lit(1)).alias("n"))


@register("a12_risk_bucket_counts", decided_sql(
    "select b.risk_bucket, count(f.risk_level) as n from (values " + ", ".join(f"('{b}')" for b in _RISK_BUCKETS)
    + ") b(risk_bucket) left join final f on f.risk_level = b.risk_bucket group by b.risk_bucket"))
def a12_risk_bucket_counts(spark, sf_dir):
    d = decided(spark, sf_dir).groupBy(D.risk_display_bucket(F.col("risk_level")).alias("risk_bucket")) \
        .agg(F.count(F.lit(1)).alias("n"))
    dim = spark.createDataFrame([(b,) for b in _RISK_BUCKETS], "risk_bucket string")
    return dim.join(d, "risk_bucket", "left").select("risk_bucket", F.coalesce("n", F.lit(0)).alias("n"))


@register("a13_severity_bins_right_closed", with_fixtures(
    """select case when anomaly_score <= 2e-1 then 'NORMAL' when anomaly_score <= 4e-1 then 'LOW RISK'
         when anomaly_score <= 6e-1 then 'MEDIUM RISK' when anomaly_score <= 8e-1 then 'HIGH RISK'
         else 'CRITICAL' end as severity_bin, count(*) as n from heats
       where anomaly_score >= 0e0 and anomaly_score <= 1e0 group by 1""", "heats"))
def a13_severity_bins_right_closed(spark, sf_dir):
    a = F.col("anomaly_score")
    b = (F.when(a <= 0.2, "NORMAL").when(a <= 0.4, "LOW RISK").when(a <= 0.6, "MEDIUM RISK")
         .when(a <= 0.8, "HIGH RISK").otherwise("CRITICAL"))
    h = heats(spark, sf_dir)
    return h.where((a >= 0) & (a <= 1)).groupBy(b.alias("severity_bin")).agg(F.count(F.lit(1)).alias("n"))


@register("a14_fleet_quality_score", with_fixtures(
    "select round(((1e0 - avg(defect_prob)) + (1e0 - avg(anomaly_score)) + (1e0 - avg(defect))) / 3e0, 9) "
    "as fleet_quality_score from heats", "heats"))
def a14_fleet_quality_score(spark, sf_dir):
    h = heats(spark, sf_dir)
    return h.agg(_r(((1 - F.avg("defect_prob")) + (1 - F.avg("anomaly_score")) + (1 - F.avg("defect"))) / 3.0)
                 .alias("fleet_quality_score"))


_STABILITY_SQL = """least(1e0, 1e0 / (1e0 + avg(feat_chemistry_instability))) as chemistry_stability,
         avg(case when feat_temp_loss < 6e1 then 1e0 else 0e0 end) as temperature_consistency,
         1e0 - avg(anomaly_score) as process_stability, 1e0 / (1e0 + avg(feat_shrinkage_risk_index)) as shrinkage_control"""
_STABILITY = ["chemistry_stability", "temperature_consistency", "process_stability", "shrinkage_control"]


def stability_scores() -> list[F.Column]:
    """The four stability scores of a featured frame as aggregates."""
    return [F.least(F.lit(1.0), 1.0 / (1.0 + F.avg("feat_chemistry_instability"))).alias("chemistry_stability"),
            F.avg((F.col("feat_temp_loss") < 60).cast("double")).alias("temperature_consistency"),
            (1.0 - F.avg("anomaly_score")).alias("process_stability"),
            (1.0 / (1.0 + F.avg("feat_shrinkage_risk_index"))).alias("shrinkage_control")]


def mean_of(columns: list[str]) -> F.Column:
    return sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)


@register("a15_stability_scores", features_sql(
    "select " + ", ".join(f"round({c}, 9) as {c}" for c in _STABILITY)
    + f", round(({' + '.join(_STABILITY)}) / 4e0, 9) as overall from (select {_STABILITY_SQL} from feat)"))
def a15_stability_scores(spark, sf_dir):
    s = featured(spark, sf_dir).agg(*stability_scores())
    return s.select(*[_r(F.col(c)).alias(c) for c in _STABILITY], _r(mean_of(_STABILITY)).alias("overall"))


@register("a16_model_accuracy", with_fixtures(
    "select round(avg(case when defect = (case when defect_prob >= 5e-1 then 1 else 0 end) then 1e0 else 0e0 end), 9)"
    " as accuracy from heats", "heats"))
def a16_model_accuracy(spark, sf_dir):
    h = heats(spark, sf_dir)
    pred = (F.col("defect_prob") >= 0.5).cast("int")
    return h.agg(_r(F.avg((F.col("defect") == pred).cast("double"))).alias("accuracy"))


@register("a17_overview_kpis", decided_sql(
    """select count(*) as total, round(avg(defect), 9) as defect_rate,
         count(*) filter (where risk_level = 'CRITICAL') as critical, round(avg(defect_prob), 9) as avg_prob,
         count(*) filter (where anomaly_score >= 6e-1) as anomalies,
         round(avg(case when defect = (case when defect_prob >= 5e-1 then 1 else 0 end) then 1e0 else 0e0 end), 9) as accuracy
       from final"""))
def a17_overview_kpis(spark, sf_dir):
    d = decided(spark, sf_dir)
    pred = (F.col("defect_prob") >= 0.5).cast("int")
    return d.agg(F.count(F.lit(1)).alias("total"), _r(F.avg("defect")).alias("defect_rate"),
                 F.count_if(F.col("risk_level") == "CRITICAL").alias("critical"),
                 _r(F.avg("defect_prob")).alias("avg_prob"),
                 F.count_if(F.col("anomaly_score") >= 0.6).alias("anomalies"),
                 _r(F.avg((F.col("defect") == pred).cast("double"))).alias("accuracy"))


@register("a18_dominant_severity", decided_sql(
    f"""select sev as anomaly_severity, n, (select concat_ws(' · ', """ + ", ".join(
        f"case when count(*) filter (where recommendation = '{r}') > 0 then "
        f"'{r}: ' || count(*) filter (where recommendation = '{r}') end" for r in _RECS)
    + f""") from final) as recommendation_summary
        from (select {_SEV_SQL} as sev, count(*) as n from final group by 1 order by n desc, 1 limit 1)"""))
def a18_dominant_severity(spark, sf_dir):
    """The most frequent severity, and the counts of the recommendations that occur."""
    d = AN.with_severity(decided(spark, sf_dir))
    top = AN.value_counts(d, "anomaly_severity").orderBy(F.desc("n"), "anomaly_severity").limit(1)
    counts = {r: F.count_if(F.col("recommendation") == r) for r in _RECS}
    summary = F.concat_ws(" · ", *[F.when(n > 0, F.concat(F.lit(f"{r}: "), n.cast("string"))) for r, n in counts.items()])
    return top.crossJoin(d.agg(summary.alias("recommendation_summary")))  # two one-row frames


@register("a19_cluster_summary", decided_sql(
    """select count(*) as total, count(distinct cluster) as n_clusters,
         count(*) filter (where risk_level = 'CRITICAL') as critical, count(*) filter (where risk_level = 'HIGH') as high,
         (select max(c) from (select count(*) as c from final group by cluster)) as largest_cluster from final"""))
def a19_cluster_summary(spark, sf_dir):
    d = decided(spark, sf_dir)
    per = d.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("risk_level") == "CRITICAL").alias("cr"),
                                   F.count_if(F.col("risk_level") == "HIGH").alias("hi"))
    return per.agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("n_clusters"),
                   F.sum("cr").alias("critical"), F.sum("hi").alias("high"), F.max("c").alias("largest_cluster"))


#: FIXED VALUES: fallback texts of batches whose rules name no action.
_FALLBACK_ACTIONS = {
    "STOP": "Stop affected castings and complete engineering review",
    "HOLD": "Hold affected castings for metallurgical review",
    "MONITOR": "Monitor process controls before release",
    "PROCEED": "Continue standard production controls",
}


@register("a20_fleet_recommendations")
def a20_fleet_recommendations(spark, sf_dir):
    """Top 3 actions over the decided batches: each batch counts once per action, under its
    display bucket; a batch without actions has the fallback of its recommendation."""
    from ..operators import rules as R
    d = decided(spark, sf_dir).withColumnsRenamed({"risk_level": "decided_risk", "recommendation": "decided_rec"})
    d = R.interpret(d).withColumn("bucket", D.risk_display_bucket(F.col("decided_risk")))
    rec = F.upper(F.trim("decided_rec"))
    texts = F.lit("Review casting risk drivers")
    for name, text in _FALLBACK_ACTIONS.items():
        texts = F.when(rec == name, F.lit(text)).otherwise(texts)
    fallback = F.when(~((F.col("bucket") == "HEALTHY") & (rec == "PROCEED")), texts)
    actions = F.when(F.size("recommendations") > 0, F.array_distinct("recommendations")).otherwise(F.array_compact(F.array(fallback)))
    ex = d.select(rank_of(F.col("bucket"), config.RISK_DISPLAY_ORDER, 0).alias("rank"), F.explode(actions).alias("action"))
    g = ex.groupBy("action").agg(F.count(F.lit(1)).alias("n_batches"), F.max("rank").alias("worst"))
    return g.orderBy(F.desc("n_batches"), "action").limit(3).select(
        "action", "n_batches", label_of(F.col("worst"), config.RISK_DISPLAY_ORDER).alias("severity"))


#: FIXED VALUES: fleet hints and the text shown when none applies.
_HINTS = [
    "Reduce pouring temperature by ~20°C or pre-heat ladle to cut heat loss and shrinkage risk.",
    "Elevated sulfur — increase desulfurisation and verify Mn/S ≥ 3 before Mg treatment.",
    "Hypoeutectic CE trend — increase carbon/silicon toward eutectic (CE ≥ 4.20).",
    "Low Mg recovery — check FSM wire speed, treatment timing, and pouring temperature.",
]
_NO_HINT = "No fleet-wide instability flags — continue standard SPC monitoring."
_HINT_TESTS_SQL = ["avg(feat_temp_loss) > 7e1", "avg(s_) > 1.5e-2",
                   "avg(case when feat_ce_calculated < 4.2e0 then 1e0 else 0e0 end) > 2e-1",
                   "avg(case when mg_recovery_ < 4e-1 then 1e0 else 0e0 end) > 1e-1"]


@register("a22_engineering_hints", features_sql(
    "select unnest(case when len(h) > 0 then h else ['" + _NO_HINT + "'] end) as hint from (select list_filter(["
    + ", ".join(f"case when {t} then '{h}' end" for t, h in zip(_HINT_TESTS_SQL, _HINTS))
    + "], lambda x: x is not null) as h from feat)"))
def a22_engineering_hints(spark, sf_dir):
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    tests = [F.avg("feat_temp_loss") > 70, F.avg("s_") > 0.015, share(F.col("feat_ce_calculated") < 4.2) > 0.2,
             share(F.col("mg_recovery_") < 0.4) > 0.1]
    a = featured(spark, sf_dir).agg(F.array_compact(F.array(*[F.when(t, F.lit(h)) for t, h in zip(tests, _HINTS)])).alias("h"))
    return a.select(F.explode(F.when(F.size("h") > 0, F.col("h")).otherwise(F.array(F.lit(_NO_HINT)))).alias("hint"))


@register("a23_defect_drivers", features_sql(
    "select parameter, round(abs_mean_diff, 9) as abs_mean_diff from (" + " union all ".join(
        f"select '{c}' as parameter, abs(avg(case when defect = 1 then {c} end) - avg(case when defect = 0 then {c} end))"
        f" as abs_mean_diff from feat" for c in DRIVER_COLS) + ") order by abs_mean_diff desc, parameter limit 10"))
def a23_defect_drivers(spark, sf_dir):
    d = AN.class_mean_differences(featured(spark, sf_dir), DRIVER_COLS)
    return d.orderBy(F.desc("abs_mean_diff"), "parameter").limit(10) \
        .select("parameter", _r(F.col("abs_mean_diff")).alias("abs_mean_diff"))


@register("a24_target_correlation", features_sql(
    "select feature, round(coalesce(abs(c), 0e0), 6) as abs_corr from (" + " union all ".join(
        f"select '{c}' as feature, corr({c}, case when k > 1 then cast(defect as double) else defect_prob end) as c "
        f"from feat, (select count(distinct defect) as k from feat) t" for c in DRIVER_COLS)
    + ") order by coalesce(abs(c), 0e0) desc, feature limit 20"))
def a24_target_correlation(spark, sf_dir):
    """Absolute correlation with the label, or with the probability where the label has one
    value; an undefined correlation counts as 0."""
    f = featured(spark, sf_dir)
    two_labels = f.agg(F.min("defect").alias("a"), F.max("defect").alias("b")).where("a <> b").count() > 0
    c = AN.target_correlations(f, DRIVER_COLS, "defect" if two_labels else "defect_prob")
    value = F.coalesce(F.abs(F.nanvl("corr", F.lit(None))), F.lit(0.0))
    return c.orderBy(F.desc(value), "feature").limit(20).select("feature", F.round(value, 6).alias("abs_corr"))


_CORR_COLS = ["c_", "si_", "s_", "mn_", "tapping_temp", "pouring_temp", "defect_prob", "anomaly_score"]


@register("a25_correlation_matrix", with_fixtures(
    "select col_a, col_b, round(c, 6) as corr from (" + " union all ".join(
        f"select '{a}' as col_a, '{b}' as col_b, corr({a}, {b}) as c from heats"
        for a in _CORR_COLS for b in _CORR_COLS) + ")", "heats"))
def a25_correlation_matrix(spark, sf_dir):
    m = AN.correlation_matrix(heats(spark, sf_dir), _CORR_COLS)
    return m.select("col_a", "col_b", F.round("corr", 6).alias("corr"))


@register("a26_subset_vs_fleet", with_fixtures(
    "select parameter, round(fleet_mean, 9) as fleet_mean, round(subset_mean, 9) as subset_mean from (" + " union all ".join(
        f"select '{c}' as parameter, avg({c}) as fleet_mean, avg(case when defect = 1 then {c} end) as subset_mean "
        f"from heats" for c in ["c_", "si_", "s_", "mn_"]) + ")", "heats"))
def a26_subset_vs_fleet(spark, sf_dir):
    h = heats(spark, sf_dir)
    cols = ["c_", "si_", "s_", "mn_"]
    w = h.agg(F.array(*[F.struct(F.lit(c).alias("parameter"), F.avg(c).alias("fleet_mean"),
                                 F.avg(F.when(F.col("defect") == 1, F.col(c))).alias("subset_mean")) for c in cols])
              .alias("a"))
    x = w.select(F.explode("a").alias("x")).select("x.*")
    return x.select("parameter", _r(F.col("fleet_mean")).alias("fleet_mean"), _r(F.col("subset_mean")).alias("subset_mean"))


@register("a28_minmax_position", with_fixtures(
    "select parameter, round((m - lo) / (hi - lo + 1e-9), 9) as position from (" + " union all ".join(
        f"select '{c}' as parameter, avg({c}) as m, min({c}) as lo, max({c}) as hi from heats"
        for c in ["c_", "si_", "s_", "mn_", "cr_", "mg_"]) + ")", "heats"))
def a28_minmax_position(spark, sf_dir):
    h = heats(spark, sf_dir)
    cols = ["c_", "si_", "s_", "mn_", "cr_", "mg_"]
    w = h.agg(F.array(*[F.struct(F.lit(c).alias("parameter"),
                                 ((F.avg(c) - F.min(c)) / (F.max(c) - F.min(c) + 1e-9)).alias("p")) for c in cols])
              .alias("a"))
    return w.select(F.explode("a").alias("x")).select("x.parameter", _r(F.col("x.p")).alias("position"))


@register("a29_probability_histogram", with_fixtures(
    """select cast(case when defect_prob = 1e0 then 29 else floor(defect_prob / (1e0 / 30e0)) end as int) as bin,
         count(*) as n from heats where defect_prob >= 0e0 and defect_prob <= 1e0 group by 1""", "heats"))
def a29_probability_histogram(spark, sf_dir):
    return AN.histogram(heats(spark, sf_dir), "defect_prob", 30, 0.0, 1.0).select("bin", "n")


@register("a32_critical_still_proceed", decided_sql(
    f"select count(*) filter (where {_SEV_SQL} = 'CRITICAL' and recommendation = 'PROCEED') as n_inconsistent "
    "from final"))
def a32_critical_still_proceed(spark, sf_dir):
    d = decided(spark, sf_dir)
    sev = severity_from_score(F.col("anomaly_score"))
    return d.agg(F.count_if((sev == "CRITICAL") & (F.col("recommendation") == "PROCEED")).alias("n_inconsistent"))


@register("a34_means_top10", with_fixtures(
    "select parameter, round(m, 9) as mean_value from (" + " union all ".join(
        f"select '{c}' as parameter, avg({c}) as m from heats" for c in _CORR_COLS)
    + ") order by m desc, parameter limit 10", "heats"))
def a34_means_top10(spark, sf_dir):
    h = heats(spark, sf_dir)
    u = AN.unpivot(h.agg(*[F.avg(c).alias(c) for c in _CORR_COLS]), _CORR_COLS, "parameter", "m")
    return u.orderBy(F.desc("m"), "parameter").limit(10).select("parameter", _r(F.col("m")).alias("mean_value"))


@register("a35_anomaly_box_by_label", with_fixtures(
    """select defect, min(anomaly_score) as min, quantile_cont(anomaly_score, 2.5e-1) as q1,
         quantile_cont(anomaly_score, 5e-1) as median, quantile_cont(anomaly_score, 7.5e-1) as q3,
         max(anomaly_score) as max, count(*) as n from heats group by defect""", "heats"))
def a35_anomaly_box_by_label(spark, sf_dir):
    return AN.five_number_summary(heats(spark, sf_dir), "anomaly_score", "defect")


@register("a36_anomaly_probability_quadrants", with_fixtures(
    """select case when anomaly_score >= 6e-1 and defect_prob >= 5e-1 then 'both'
         when anomaly_score >= 6e-1 then 'anomaly_only' when defect_prob >= 5e-1 then 'probability_only'
         else 'neither' end as quadrant, count(*) as n from heats group by 1""", "heats"))
def a36_anomaly_probability_quadrants(spark, sf_dir):
    a, p = F.col("anomaly_score"), F.col("defect_prob")
    q = (F.when((a >= 0.6) & (p >= 0.5), "both").when(a >= 0.6, "anomaly_only")
         .when(p >= 0.5, "probability_only").otherwise("neither"))
    return heats(spark, sf_dir).groupBy(q.alias("quadrant")).agg(F.count(F.lit(1)).alias("n"))


@register("a37_counts_by_furnace", with_fixtures("select furnace, count(*) as n from heats group by furnace", "heats"))
def a37_counts_by_furnace(spark, sf_dir):
    return AN.value_counts(heats(spark, sf_dir), "furnace")


@register("a38_session_summary", decided_sql(
    """select count(*) as batches, round(avg(defect), 9) as defect_rate,
         count(*) filter (where recommendation in ('HOLD', 'STOP')) as hold_or_stop from final"""))
def a38_session_summary(spark, sf_dir):
    d = decided(spark, sf_dir)
    return d.agg(F.count(F.lit(1)).alias("batches"), _r(F.avg("defect")).alias("defect_rate"),
                 F.count_if(F.col("recommendation").isin("HOLD", "STOP")).alias("hold_or_stop"))


@register("a40_status_bands", features_sql(
    "select name, round(v, 9) as value, case when v >= 7e-1 then 'good' when v >= 5e-1 then 'warn' else 'poor' end as status from ("
    + " union all ".join(f"select '{c}' as name, {c} as v from (select {_STABILITY_SQL} from feat)" for c in _STABILITY) + ")"))
def a40_status_bands(spark, sf_dir):
    """Each stability score with its band."""
    s = AN.unpivot(featured(spark, sf_dir).agg(*stability_scores()), _STABILITY, "name", "v")
    return s.select("name", _r(F.col("v")).alias("value"), EV.status_band(F.col("v"), 0.7, 0.5).alias("status"))


@register("a41_recommendation_kpis", decided_sql(
    "select " + ", ".join(f"count(*) filter (where recommendation = '{r}') as n_{r.lower()}" for r in _RECS)
    + " from final"))
def a41_recommendation_kpis(spark, sf_dir):
    d = decided(spark, sf_dir)
    return d.agg(*[F.count_if(F.col("recommendation") == r).alias(f"n_{r.lower()}") for r in _RECS])


# ---------------------------------------------------------------------------
# W*: windows, ordering, top-k
# ---------------------------------------------------------------------------
@register("w1_rolling_defect_trend", with_fixtures(
    """select seq, furnace_id, round(coalesce(r, first_value(r ignore nulls) over (partition by furnace_id order by seq
         rows between current row and unbounded following), last_value(r ignore nulls) over (partition by furnace_id
         order by seq rows between unbounded preceding and current row)), 9) as rolling_defect_rate from (
         select seq, furnace_id, case when count(defect) over w >= 2 then avg(defect) over w end as r
         from heat_events window w as (partition by furnace_id order by seq rows between 49 preceding and current row)) t""",
    "heat_events"))
def w1_rolling_defect_trend(spark, sf_dir):
    ev = heat_events(spark, sf_dir)
    out = W.rolling_mean(ev, ["furnace_id"], "seq", "defect", config.ROLLING_WINDOW, config.ROLLING_MIN_PERIODS)
    return out.select("seq", "furnace_id", _r(F.col("rolling_defect")).alias("rolling_defect_rate"))


@register("w2_row_position", with_fixtures(
    "select seq, cast(row_number() over (order by seq) as bigint) as position from heat_events", "heat_events"))
def w2_row_position(spark, sf_dir):
    from ..plans.ordered import row_positions
    ev = heat_events(spark, sf_dir).select("seq")
    return row_positions(ev, [], ["seq"], "position").select("seq", "position")


@register("w5_dangerous_batches", decided_sql(
    f"""select {KEY}, risk_level, recommendation, final_risk_score, anomaly_score from final
        order by final_risk_score desc, anomaly_score desc, {KEY} limit 30"""))
def w5_dangerous_batches(spark, sf_dir):
    d = decided(spark, sf_dir)
    return d.orderBy(F.desc("final_risk_score"), F.desc("anomaly_score"), *HEAT_KEY).limit(
        config.TOP_DANGEROUS).select(*HEAT_KEY, "risk_level", "recommendation", "final_risk_score", "anomaly_score")


@register("w6_top_anomalies", with_fixtures(
    f"select {KEY}, anomaly_score from heats order by anomaly_score desc, {KEY} limit 25", "heats"))
def w6_top_anomalies(spark, sf_dir):
    h = heats(spark, sf_dir)
    return h.orderBy(F.desc("anomaly_score"), *HEAT_KEY).limit(config.TOP_ANOMALIES).select(*HEAT_KEY, "anomaly_score")


@register("w8_worst_severity_per_furnace", with_fixtures(
    f"""select furnace, case max(case {_SEV_SQL} when 'NORMAL' then 0 when 'LOW RISK' then 1 when 'MEDIUM RISK' then 2
         when 'HIGH RISK' then 3 else 4 end) when 0 then 'NORMAL' when 1 then 'LOW RISK' when 2 then 'MEDIUM RISK'
         when 3 then 'HIGH RISK' else 'CRITICAL' end as worst_severity from heats group by furnace""", "heats"))
def w8_worst_severity_per_furnace(spark, sf_dir):
    from ..functions.scalar import label_of
    h = AN.with_severity(heats(spark, sf_dir))
    g = h.groupBy("furnace").agg(F.max(severity_rank(F.col("anomaly_severity"))).alias("r"))
    return g.select("furnace", label_of(F.col("r"), config.SEVERITY_ORDER).alias("worst_severity"))


@register("w9_scatter_frame", decided_sql(
    f"""select {KEY}, 1e2 * p as x, a as y, 'Defect Probability (%)' as x_title, 'Anomaly Score' as y_title,
          recommendation as status, risk_level as risk, coalesce(cast(cluster as int), -1) as cluster from final"""))
def w9_scatter_frame(spark, sf_dir):
    """One point per batch: the scores as axes (the fixture has no PCs), status from the recommendation."""
    d = decided(spark, sf_dir)
    rec = D.normalize_recommendation(F.col("recommendation"))
    return d.select(*HEAT_KEY, (100.0 * clamp01_scalar(F.col("defect_prob"))).alias("x"),
                    clamp01_scalar(F.col("anomaly_score")).alias("y"),
                    F.lit("Defect Probability (%)").alias("x_title"), F.lit("Anomaly Score").alias("y_title"),
                    F.when(rec.isin(*_RECS), rec).otherwise("PROCEED").alias("status"),
                    D.risk_display_bucket(F.col("risk_level")).alias("risk"), D.cluster_id("cluster").alias("cluster"))


@register("w10_cluster_highlight", with_fixtures(
    f"""select {KEY}, c_ as x, si_ as y, cluster, cluster = 2 as highlighted,
          row_number() over (order by anomaly_score desc, {KEY}) = 1 as selected from heats""", "heats"))
def w10_cluster_highlight(spark, sf_dir):
    """Point frame with one cluster and the most anomalous batch marked (first two measures as axes)."""
    h = heats(spark, sf_dir)
    top = h.orderBy(F.desc("anomaly_score"), *HEAT_KEY).limit(1).select(*[F.col(k).alias(f"top_{k}") for k in HEAT_KEY])
    same = F.lit(True)
    for k in HEAT_KEY:
        same = same & (F.col(k) == F.col(f"top_{k}"))
    return h.crossJoin(F.broadcast(top)).select(  # one row
        *HEAT_KEY, F.col("c_").alias("x"), F.col("si_").alias("y"), "cluster", (F.col("cluster") == 2).alias("highlighted"),
        same.alias("selected"))


# ---------------------------------------------------------------------------
# J*: lookups and set operations
# ---------------------------------------------------------------------------
@register("j2_profile_lookup", features_sql(
    f"""select {KEY}, round(p.defect_rate, 4) as cluster_defect_rate from feat f join
        (select cluster, avg(defect) as defect_rate from feat group by cluster) p on f.cluster = p.cluster"""))
def j2_profile_lookup(spark, sf_dir):
    from ..plans.lookup import attach
    f = featured(spark, sf_dir)
    prof = heats(spark, sf_dir).groupBy("cluster").agg(F.avg("defect").alias("defect_rate"))
    return attach(f.select(*HEAT_KEY, "cluster"), prof, "cluster", "inner").select(
        *HEAT_KEY, F.round("defect_rate", 4).alias("cluster_defect_rate"))


@register("j4_severity_rank_map", with_fixtures(
    f"""select case {_SEV_SQL} when 'NORMAL' then 0 when 'LOW RISK' then 1 when 'MEDIUM RISK' then 2
          when 'HIGH RISK' then 3 else 4 end as severity_int, count(*) as n from heats group by 1""", "heats"))
def j4_severity_rank_map(spark, sf_dir):
    h = AN.with_severity(heats(spark, sf_dir))
    return h.groupBy(severity_rank(F.col("anomaly_severity")).alias("severity_int")).agg(F.count(F.lit(1)).alias("n"))


@register("j5_global_stat_attach", with_fixtures(
    f"select {KEY}, round(c_ - (select avg(c_) from heats), 9) as c_vs_fleet from heats", "heats"))
def j5_global_stat_attach(spark, sf_dir):
    from ..plans.lookup import attach_scalar_row
    h = heats(spark, sf_dir)
    j = attach_scalar_row(h, h.agg(F.avg("c_").alias("__m")))
    return j.select(*HEAT_KEY, _r(F.col("c_") - F.col("__m")).alias("c_vs_fleet"))


@register("j6_column_set_difference", with_fixtures(
    "select 'furnace' as column_name, 'extra' as status, count(furnace) as n_values from heats_raw "
    "union all select 'si_', 'missing', cast(0 as bigint) "
    "union all select 'tapping_temp', 'matched', count(tapping_temp) from heats_raw "
    "union all select 'pouring_temp', 'matched', count(pouring_temp) from heats_raw "
    "union all select 'mg_recovery', 'matched', count(mg_recovery) from heats_raw", "heats_raw"))
def j6_column_set_difference(spark, sf_dir):
    from ..operators.schema import template_report
    from ..sources.fixtures import heats_raw
    h = heats_raw(spark, sf_dir)
    cols = [c for c in h.columns if c not in HEAT_KEY + ["empty_col", "defected"]]
    rep = template_report(spark, cols, ["tapping_temp", "pouring_temp", "mg_recovery", "si_"])
    counts = AN.unpivot(h.agg(*[F.count(c).alias(c) for c in cols]), cols, "column_name", "n")
    return rep.withColumnRenamed("column", "column_name").join(counts, "column_name", "left").select(
        "column_name", "status", F.coalesce(F.col("n").cast("long"), F.lit(0).cast("long")).alias("n_values"))


@register("j3_positional_attach", with_fixtures(
    f"""select {KEY}, p.defect_prob from (select {KEY}, row_number() over (order by {KEY}) as i from heats) h
        join (select defect_prob, row_number() over (order by defect_prob) as i from heats) p using (i)""", "heats"))
def j3_positional_attach(spark, sf_dir):
    """Row i of one ordered frame beside row i of another."""
    h = heats(spark, sf_dir)
    # equal probabilities are dealt by a hash of the key: sorted by value alone, all rows of a value would be one task's
    ranked = h.orderBy("defect_prob", F.xxhash64(*HEAT_KEY)).select("defect_prob")
    return attach_by_position(h.select(*HEAT_KEY).orderBy(*HEAT_KEY), ranked)


@register("j7_append_history", with_fixtures(
    "select count(*) as n_rows from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, defect from "
    "(select * from heats union all select * from heats where cluster = 0))", "heats"))
def j7_append_history(spark, sf_dir):
    h = heats(spark, sf_dir).select(*HEAT_KEY, "defect")
    new = heats(spark, sf_dir).where(F.col("cluster") == 0).select(*HEAT_KEY, "defect")
    return h.unionByName(new, allowMissingColumns=True).dropDuplicates().agg(F.count(F.lit(1)).alias("n_rows"))
