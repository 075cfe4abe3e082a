"""Remaining inventory rows: C18, A21, A27, A30, A31, A33, A39, W3, W4, W7,
M29, M31-M33, S2, S5, S14, S17, H14/H15."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import rank_of, severity_from_score
from ..operators import analytics as AN
from ..operators import cleaning as C
from ..operators import decisions as D
from ..operators import evaluation as EV
from ..operators import neighbours as NB
from ..operators import schema as H
from ..operators import windows as W
from ..plans.registry import register
from ..sources import io as IO
from ..sources.fixtures import HEAT_KEY, heats, heats_raw, points5, preds, with_fixtures
from ..sources.tables import table_path
from .analytics import _SEV_SQL, _STABILITY, _STABILITY_SQL, mean_of, stability_scores
from .core import decided, featured
from .sqlparts import KEY, decided_sql, features_sql

_BUCKETS = config.RISK_DISPLAY_ORDER


def _r(c, n=9):
    return F.round(c, n)


@register("c18_zscore_fallback_score", with_fixtures(
    f"""select {KEY}, round((raw - mn) / (mx - mn + 1e-9), 6) as derived_score from
        (select {KEY}, ((coalesce(abs((c_ - m1) / nullif(s1, 0e0)), 0e0) + coalesce(abs((si_ - m2) / nullif(s2, 0e0)), 0e0))
           + coalesce(abs((s_ - m3) / nullif(s3, 0e0)), 0e0)) / 3e0 as raw from heats,
           (select avg(c_) as m1, stddev_samp(c_) as s1, avg(si_) as m2, stddev_samp(si_) as s2,
                   avg(s_) as m3, stddev_samp(s_) as s3 from heats) st) r,
        (select min(raw) as mn, max(raw) as mx from
           (select ((coalesce(abs((c_ - m1) / nullif(s1, 0e0)), 0e0) + coalesce(abs((si_ - m2) / nullif(s2, 0e0)), 0e0))
              + coalesce(abs((s_ - m3) / nullif(s3, 0e0)), 0e0)) / 3e0 as raw from heats,
              (select avg(c_) as m1, stddev_samp(c_) as s1, avg(si_) as m2, stddev_samp(si_) as s2,
                      avg(s_) as m3, stddev_samp(s_) as s3 from heats) st)) b""", "heats"))
def c18_zscore_fallback_score(spark, sf_dir):
    h = heats(spark, sf_dir).select(*HEAT_KEY, "c_", "si_", "s_")
    out = C.zscore_fallback_score(h, ["c_", "si_", "s_"])
    return out.select(*HEAT_KEY, _r(F.col("derived_score"), 6).alias("derived_score"))


@register("a21_recommendation_card", decided_sql(
    """select total, healthy, total - healthy as risky, (select bucket from (select bucket, count(*) as n,
           case bucket when 'HEALTHY' then 0 when 'LOW' then 1 when 'MEDIUM' then 2 when 'HIGH' then 3 else 4 end as pos
           from b group by bucket) order by n desc, pos limit 1) as most_common_risk
       from (select count(*) as total, count(*) filter (where bucket = 'HEALTHY') as healthy from b)""".replace(
        "from b", "from (select case when risk_level in ('NORMAL','OK','PASS','ACCEPT','ACCEPTABLE','NONE','NAN','HEALTHY') "
        "then 'HEALTHY' else risk_level end as bucket from final) b")))
def a21_recommendation_card(spark, sf_dir):
    """Healthy is the HEALTHY display bucket, risky all others; the largest bucket (first in display order on ties)."""
    counts = decided(spark, sf_dir).groupBy(D.risk_display_bucket(F.col("risk_level")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))
    rank = rank_of(F.col("bucket"), _BUCKETS, 0)
    return counts.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("bucket") == "HEALTHY", F.col("n"))), F.lit(0)).alias("healthy"),
                      F.max_by("bucket", F.struct("n", -rank)).alias("most_common_risk")).select(
        "total", "healthy", (F.col("total") - F.col("healthy")).alias("risky"), "most_common_risk")


#: FIXED VALUES: axes of the selected-versus-healthy profile.
_RADAR = {"Si": "si_", "Mn": "mn_", "Mg recovery": "mg_recovery_", "Pouring temp": "pouring_temp", "Tapping temp": "tapping_temp",
          "Chemistry stability": "feat_chemistry_instability", "Shrinkage index": "feat_shrinkage_risk_index",
          "Gas index": "feat_gas_risk_index"}


@register("a27_selected_vs_healthy", features_sql(
    "select parameter, round(healthy_mean, 9) as healthy_mean, round(selected_value, 9) as selected_value from ("
    + " union all ".join(
        f"select '{label}' as parameter, (select coalesce(avg(case when coalesce(defect, 0) = 0 then {c} end), "
        f"avg(case when defect_prob < 5e-1 then {c} end), avg({c})) from feat) as healthy_mean, "
        f"(select {c} from feat order by anomaly_score desc, {KEY} limit 1) as selected_value" for label, c in _RADAR.items())
    + ")"))
def a27_selected_vs_healthy(spark, sf_dir):
    """The most anomalous batch against the healthy batches: those without a defect, else those
    below half probability, else all."""
    f = featured(spark, sf_dir)
    fine, likely = F.coalesce(F.col("defect"), F.lit(0)) == 0, F.col("defect_prob") < 0.5
    counts = f.agg(F.count_if(fine).alias("fine"), F.count_if(likely).alias("likely")).first()
    healthy = f.where(fine if counts["fine"] else likely if counts["likely"] else F.lit(True))
    healthy = healthy.agg(*[F.avg(c).alias(c) for c in _RADAR.values()])
    selected = f.orderBy(F.desc("anomaly_score"), *HEAT_KEY).limit(1).select(*[F.col(c).alias(f"s_{c}") for c in _RADAR.values()])
    j = healthy.crossJoin(selected)  # two one-row frames
    return j.select(F.explode(F.array(*[F.struct(F.lit(label).alias("parameter"), _r(F.col(c)).alias("healthy_mean"),
                                                 _r(F.col(f"s_{c}").cast("double")).alias("selected_value"))
                                        for label, c in _RADAR.items()])).alias("x")).select("x.*")


@register("a30_fleet_summary_rows", decided_sql(
    """select 'Total batches' as metric, (select cast(count(*) as varchar) from final) as value
       union all select 'Avg defect probability', (select printf('%.1f%%', avg(defect_prob) * 1e2) from final)
       union all select 'Critical batches', (select cast(count(*) filter (where risk_level = 'CRITICAL') as varchar) from final)
       """ + " ".join(f"union all select 'Recommendation {r}', (select cast(count(*) filter (where recommendation = '{r}') as varchar) from final)"
                      for r in ("PROCEED", "MONITOR", "HOLD", "STOP"))
    + " ".join(f" union all select 'Selected {name}', (select cast({c} as varchar) from final order by anomaly_score desc, {KEY} limit 1)"
               for name, c in (("batch index", "l_orderkey"), ("risk level", "risk_level"), ("recommendation", "recommendation")))))
def a30_fleet_summary_rows(spark, sf_dir):
    """Metric / value rows of the fleet and of the most anomalous batch."""
    d = decided(spark, sf_dir)
    text = lambda c: c.cast("string")
    rows = {"Total batches": text(F.count(F.lit(1))),
            "Avg defect probability": F.format_string("%.1f%%", F.avg("defect_prob") * 100.0),
            "Critical batches": text(F.count_if(F.col("risk_level") == "CRITICAL"))}
    rows |= {f"Recommendation {r}": text(F.count_if(F.col("recommendation") == r)) for r in ("PROCEED", "MONITOR", "HOLD", "STOP")}
    one = d.agg(*[c.alias(f"v{i}") for i, c in enumerate(rows.values())])
    top = d.orderBy(F.desc("anomaly_score"), *HEAT_KEY).limit(1).select(
        text(F.col("l_orderkey")).alias("s0"), F.col("risk_level").alias("s1"), F.col("recommendation").alias("s2"))
    named = [*((name, f"v{i}") for i, name in enumerate(rows)), ("Selected batch index", "s0"), ("Selected risk level", "s1"),
             ("Selected recommendation", "s2")]
    j = one.crossJoin(top)  # two one-row frames
    return j.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in named])).alias("x")).select("x.*")


@register("a31_batch_vs_fleet", with_fixtures(
    "select parameter, round(batch_value - fleet_mean, 9) as delta from (" + " union all ".join(
        f"select '{c}' as parameter, (select {c} from heats order by anomaly_score desc, {KEY} limit 1) as batch_value, "
        f"(select avg({c}) from heats) as fleet_mean" for c in ["c_", "si_", "s_", "tapping_temp", "pouring_temp", "defect_prob"])
    + ")", "heats"))
def a31_batch_vs_fleet(spark, sf_dir):
    h = heats(spark, sf_dir)
    cols = ["c_", "si_", "s_", "tapping_temp", "pouring_temp", "defect_prob"]
    batch = h.orderBy(F.desc("anomaly_score"), *HEAT_KEY).limit(1).select(*[F.col(c).alias(f"b_{c}") for c in cols])
    fleet = h.agg(*[F.avg(c).alias(f"m_{c}") for c in cols])
    j = batch.crossJoin(fleet)
    return j.select(F.explode(F.array(*[F.struct(F.lit(c).alias("parameter"),
                                                 _r(F.col(f"b_{c}") - F.col(f"m_{c}")).alias("delta")) for c in cols]))
                    .alias("x")).select("x.*")


#: FIXED VALUES: parts of a feature's name that tell its group, in order of precedence.
_GROUP_PARTS = [
    ("chemistry", ["c_", "si", "mn", "s_", "ce", "chem", "carbon", "sulfur"]),
    ("thermal", ["temp", "pour", "tap", "heat"]),
    ("additive", ["mg", "barinoc", "inoc", "add"]),
    ("engineered", ["risk", "instability", "loss", "ratio"]),
]
_GROUP_COLS = ["c_", "al__", "p__", "tapping_temp", "pouring_temp", "feat_temp_loss", "mg_recovery_", "fsmaddition_mt", "heel", "crca",
               "feat_gas_risk_index", "feat_heel_ratio"]


def _feature_group(name: F.Column) -> F.Column:
    n, out = F.lower(name), None
    for group, parts in _GROUP_PARTS:
        hit = F.lit(False)
        for part in parts:
            hit = hit | n.contains(part)
        if group == "engineered":
            hit = hit | n.startswith("feat_")
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise("other")


@register("a33_importance_group_rollup", features_sql(
    "select grp, round(sum(w) * 1e2 / (select sum(w) from imp), 6) as pct from (select "
    + "case " + " ".join(
        f"when regexp_matches(feature, '{'|'.join(parts)}{'|^feat_' if g == 'engineered' else ''}') then '{g}'" for g, parts in _GROUP_PARTS)
    + " else 'other' end as grp, w from imp) group by grp",
    extra={"imp": " union all ".join(
        f"select '{c}' as feature, abs(corr({c}, cast(defect as double))) as w from feat" for c in _GROUP_COLS)}))
def a33_importance_group_rollup(spark, sf_dir):
    imp = AN.target_correlations(featured(spark, sf_dir), _GROUP_COLS).select(
        _feature_group(F.col("feature")).alias("grp"), F.abs("corr").alias("w"))
    tot = imp.agg(F.sum("w").alias("t"))
    return imp.groupBy("grp").agg(F.sum("w").alias("s")).crossJoin(tot).select(
        "grp", F.round(F.col("s") * 100.0 / F.col("t"), 6).alias("pct"))


@register("a39_fleet_overview", decided_sql(
    f"""select round(quality, 9) as quality_score, round(({' + '.join(_STABILITY)}) / 4e0, 9) as process_stability,
         (select {_SEV_SQL} from final group by 1 order by count(*) desc, 1 limit 1) as dominant_severity,
         round(prob, 9) as avg_prob, critical
       from (select ((1e0 - avg(defect_prob)) + (1e0 - avg(anomaly_score)) + (1e0 - avg(defect))) / 3e0 as quality,
               {_STABILITY_SQL}, avg(defect_prob) as prob, count(*) filter (where risk_level = 'CRITICAL') as critical from final)"""))
def a39_fleet_overview(spark, sf_dir):
    """Quality, mean stability, dominant severity, mean probability and critical batches."""
    d = AN.with_severity(decided(spark, sf_dir))
    quality = ((1 - F.avg("defect_prob")) + (1 - F.avg("anomaly_score")) + (1 - F.avg("defect"))) / 3.0
    one = d.agg(quality.alias("quality"), *stability_scores(), F.avg("defect_prob").alias("prob"),
                F.count_if(F.col("risk_level") == "CRITICAL").alias("critical"))
    top = AN.value_counts(d, "anomaly_severity").orderBy(F.desc("n"), "anomaly_severity").limit(1)
    return one.crossJoin(top).select(  # two one-row frames
        _r(F.col("quality")).alias("quality_score"), _r(mean_of(_STABILITY)).alias("process_stability"),
        F.col("anomaly_severity").alias("dominant_severity"), _r(F.col("prob")).alias("avg_prob"), "critical")


@register("w3_cumulative_share", with_fixtures(
    """select cluster, round(share, 9) as cumulative_share, cluster = min(cluster) filter (share >= 9e-1) over () as first_at_90 from
         (select cluster, sum(n) over (order by cluster) * 1e0 / sum(n) over () as share from
           (select cluster, count(*) as n from heats group by cluster))""", "heats"))
def w3_cumulative_share(spark, sf_dir):
    """Cumulative share and the first entry that reaches 90 %."""
    g = heats(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("n"))
    tot = g.agg(F.sum("n").alias("t"))
    c = W.cumulative_share(g, "cluster", "n", "cum").crossJoin(tot).withColumn("share", F.col("cum") / F.col("t"))
    first = c.where(F.col("share") >= 0.9).agg(F.min("cluster").alias("first"))
    return c.crossJoin(first).select("cluster", _r(F.col("share")).alias("cumulative_share"),
                                     (F.col("cluster") == F.col("first")).alias("first_at_90"))


@register("w4_cumulative_tp_fp", with_fixtures(
    "select threshold, tp, fp from (select score as threshold, sum(pos) over (order by score desc) as tp, "
    "sum(neg) over (order by score desc) as fp from (select p as score, sum(y) as pos, sum(1 - y) as neg "
    "from preds group by p))", "preds"))
def w4_cumulative_tp_fp(spark, sf_dir):
    return EV.curve_points(preds(spark, sf_dir)).select("threshold", "tp", "fp")


@register("w7_best_of_leaderboard", with_fixtures(
    "select furnace, round(avg(defect), 9) as defect_rate from heats group by furnace "
    "order by avg(defect) asc, furnace limit 1", "heats"))
def w7_best_of_leaderboard(spark, sf_dir):
    g = heats(spark, sf_dir).groupBy("furnace").agg(F.avg("defect").alias("r"))
    return g.orderBy("r", "furnace").limit(1).select("furnace", _r(F.col("r")).alias("defect_rate"))


_SQD5 = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(1, 6))


@register("m29_cluster_validation", with_fixtures(
    f"""select ab.ca as label, round(avg(case when sz.n <= 1 or ab.b is null then 0e0
          else (ab.b - ab.a) / greatest(ab.a, ab.b) end), 6) as silhouette, count(*) as batch_count
        from (select vec_id, ca, max(case when ca = cb then m end) as a, min(case when ca <> cb then m end) as b
              from (select a.vec_id, a.label as ca, b.label as cb, avg({_SQD5}) as m
                    from points5 a join points5 b on a.vec_id <> b.vec_id group by 1, 2, 3) per
              group by 1, 2) ab join (select label, count(*) as n from points5 group by label) sz on ab.ca = sz.label
        group by ab.ca""", "points5"))
def m29_cluster_validation(spark, sf_dir):
    p = points5(spark, sf_dir)
    sil = NB.silhouette_sq(p, ["x1", "x2", "x3", "x4", "x5"], "label")
    return sil.select("label", F.round("silhouette", 6).alias("silhouette"), F.col("n").alias("batch_count"))


@register("m32_explained_variance_frame")
def m32_explained_variance_frame(spark, sf_dir):
    from ..operators import models as MD
    from .models import MODEL_FEATURES
    _b, _m, ev, k = MD.pca_fit(featured(spark, sf_dir), MODEL_FEATURES)
    g = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(ev)], "component int, explained double")
    return W.cumulative_share(g, "component", "explained", "cumulative").withColumn("chosen_k", F.lit(k))


@register("m33_importance_labels", features_sql(
    "select feature, array_to_string(list_transform(string_split(trim(replace(regexp_replace(feature, '^feat_', ''), "
    "'_', ' ')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as label, "
    "round(abs(c), 6) as importance from (" + " union all ".join(
        f"select '{c}' as feature, corr({c}, cast(defect as double)) as c from feat"
        for c in ["feat_temp_loss", "feat_ce_calculated", "feat_gas_risk_index", "feat_shrinkage_risk_index",
                  "feat_chemistry_instability", "mg_recovery_"]) + ") where c is not null "
    "order by abs(c) desc, feature limit 15"))
def m33_importance_labels(spark, sf_dir):
    cols = ["feat_temp_loss", "feat_ce_calculated", "feat_gas_risk_index", "feat_shrinkage_risk_index",
            "feat_chemistry_instability", "mg_recovery_"]
    c = AN.target_correlations(featured(spark, sf_dir), cols).where(F.col("corr").isNotNull())
    label = F.initcap(F.trim(F.regexp_replace(F.regexp_replace("feature", "^feat_", ""), "_", " ")))
    return c.orderBy(F.desc(F.abs("corr")), "feature").limit(15).select(
        "feature", label.alias("label"), F.round(F.abs("corr"), 6).alias("importance"))


@register("s2_typed_scan", with_fixtures(
    "select count(*) as n_rows, round(sum(l_quantity), 6) as sum_qty from lineitem", "heats"))
def s2_typed_scan(spark, sf_dir):
    df = IO.read_typed(spark, table_path(sf_dir, "lineitem"), "l_orderkey long, l_quantity double")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("l_quantity"), 6).alias("sum_qty"))


@register("s5_first_labelled_source", with_fixtures(
    "select count(*) as n_rows, sum(defect) as n_defect from heats", "heats"))
def s5_first_labelled_source(spark, sf_dir):
    path = IO.scratch_path(spark, "labelled")
    IO.write_table(heats(spark, sf_dir).select(*HEAT_KEY, "defect"), path + ".parquet")
    df, _p = IO.first_available(spark, [table_path(sf_dir, "orders"), path + ".parquet"], require=["defect"])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("defect").alias("n_defect"))


@register("s14_model_save_load")
def s14_model_save_load(spark, sf_dir):
    from pyspark.ml import PipelineModel
    from ..operators import models as MD
    from .models import MODEL_FEATURES
    f = featured(spark, sf_dir)
    model = MD.fit_classifier(MD.with_class_weights(f), MODEL_FEATURES,
                              MD.candidates(1)["logistic_regression"].setRegParam(1e-3))
    path = IO.scratch_path(spark, "model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    return MD.score(loaded, f, HEAT_KEY).groupBy("yhat").agg(F.count(F.lit(1)).alias("n"))


@register("s17_template_header", with_fixtures(
    "select 0 as ordinal, 'tapping_temp' as column_name, count(*) as n_rows from heats_raw union all "
    "select 1, 'pouring_temp', count(*) from heats_raw union all select 2, 'mg_recovery', count(*) from heats_raw",
    "heats_raw"))
def s17_template_header(spark, sf_dir):
    path = IO.scratch_path(spark, "template")
    IO.write_table(heats_raw(spark, sf_dir).select("tapping_temp", "pouring_temp", "mg_recovery"), path, "csv")
    cols = IO.header_of(spark, path)
    df = IO.read_all_strings(spark, path, cols)
    agg = df.agg(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"),
                                    F.count(F.lit(1)).alias("n_rows")) for i, c in enumerate(cols)]).alias("a"))
    return agg.select(F.explode("a").alias("x")).select("x.*")


@register("h14_h15_template_contract", with_fixtures(
    "select 'tapping_temp' as column_name, 'matched' as status, count(tapping_temp) as n_values from heats_raw "
    "union all select 'mg_recovery', 'matched', count(mg_recovery) from heats_raw "
    "union all select 'furnace', 'extra', count(furnace) from heats_raw "
    "union all select 'si_', 'missing', cast(0 as bigint)", "heats_raw"))
def h14_h15_template_contract(spark, sf_dir):
    h = heats_raw(spark, sf_dir).select("tapping_temp", "mg_recovery", "furnace")
    rep = H.template_report(spark, h.columns, ["Tapping Temp", "MG Recovery", "si_"])
    present = [c for c in h.columns]
    counts = h.agg(*[F.count(c).alias(c) for c in present])
    long = AN.unpivot(counts, present, "column_name", "n").select("column_name", F.col("n").cast("long").alias("n"))
    r = rep.select(F.col("column").alias("column_name"), "status")
    return r.join(long, "column_name", "left").select("column_name", "status",
                                                       F.coalesce("n", F.lit(0).cast("long")).alias("n_values"))


@register("a29_confidence_histogram", with_fixtures(
    """select cast(case when c = 1e0 then 19 else floor((c - 5e-1) / 2.5e-2) end as int) as bin, count(*) as n
       from (select greatest(p, 1e0 - p) as c from preds) where c >= 5e-1 and c <= 1e0 group by 1""", "preds"))
def a29_confidence_histogram(spark, sf_dir):
    """A29 (third variant): confidence max(p, 1-p) in 0.025-wide bins over [0.5, 1]."""
    pr = preds(spark, sf_dir).select(F.greatest(F.col("p"), 1 - F.col("p")).alias("c"))
    return AN.histogram(pr, "c", 20, 0.5, 1.0).select("bin", "n")


@register("a29_value_histogram", with_fixtures(
    """select cast(case when pouring_temp = mx then 39 else floor((pouring_temp - mn) / ((mx - mn) / 4e1)) end as int)
         as bin, count(*) as n from heats, (select min(pouring_temp) as mn, max(pouring_temp) as mx from heats) b
       group by 1""", "heats"))
def a29_value_histogram(spark, sf_dir):
    """A29 (first variant): up to 40 equal bins between the column's min and max."""
    return AN.histogram(heats(spark, sf_dir), "pouring_temp", 40).select("bin", "n")
