"""Evaluation entries (M1, M2, M19-M27) over the ``preds`` fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as EV
from ..plans.registry import register
from ..sources.fixtures import HEAT_KEY, heats, preds, with_fixtures
from .sqlparts import KEY

_H = ("((42 + (l_orderkey % 1000003) * 2654435761 + (l_linenumber % 1000003) * 40503 + (l_partkey % 1000003) * 97 + l_suppkey % 1000003) % 1000003)")
_RANKED = (f"select *, row_number() over (partition by y order by {_H}, l_orderkey, l_linenumber, l_partkey, "
           "l_suppkey) as rk, count(*) over (partition by y) as n from preds")


def _r(c, n=9):
    return F.round(c, n)


@register("m1_stratified_split", with_fixtures(
    f"select {KEY}, y, case when rk <= round(n * 2e-1) then 'test' else 'train' end as split from ranked", "preds",
    ctes={"ranked": _RANKED}))
def m1_stratified_split(spark, sf_dir):
    return EV.stratified_split(preds(spark, sf_dir), "y", HEAT_KEY).select(*HEAT_KEY, "y", "split")


@register("m2_stratified_folds", with_fixtures(
    f"select {KEY}, y, cast((rk - 1) % 5 as int) as fold from ranked", "preds", ctes={"ranked": _RANKED}))
def m2_stratified_folds(spark, sf_dir):
    return EV.stratified_folds(preds(spark, sf_dir), "y", HEAT_KEY).select(*HEAT_KEY, "y", "fold")


_CONF = ("select count(*) filter (where y = 1 and yhat = 1) as tp, count(*) filter (where y = 0 and yhat = 1) as fp, "
         "count(*) filter (where y = 1 and yhat = 0) as fn, count(*) filter (where y = 0 and yhat = 0) as tn "
         "from preds")
_AUC = ("select (sum(pos * (cum - (pos + neg) + (pos + neg + 1) / 2e0)) - sum(pos) * (sum(pos) + 1) / 2e0) "
        "/ (sum(pos) * sum(neg)) as roc_auc from (select *, sum(pos + neg) over (order by score) as cum from "
        "(select p as score, sum(y) as pos, sum(1 - y) as neg from preds group by p))")


@register("m19_classification_metrics", with_fixtures(
    """select round((tp + tn) * 1e0 / (tp + fp + fn + tn), 9) as accuracy,
         round(coalesce(tp * 1e0 / nullif(tp + fp, 0), 0e0), 9) as precision,
         round(coalesce(tp * 1e0 / nullif(tp + fn, 0), 0e0), 9) as recall,
         round(coalesce(2e0 * (tp * 1e0 / (tp + fp)) * (tp * 1e0 / (tp + fn)) /
           nullif(tp * 1e0 / (tp + fp) + tp * 1e0 / (tp + fn), 0e0), 0e0), 9) as f1,
         round(a.roc_auc, 9) as roc_auc from conf, auc a""", "preds", ctes={"conf": _CONF, "auc": _AUC}))
def m19_classification_metrics(spark, sf_dir):
    m = EV.classification_metrics(preds(spark, sf_dir))
    return m.select(*[_r(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])


@register("m20_confusion_matrix", with_fixtures(
    "select tp, fp, fn, tn, round(fp * 1e0 / nullif(fp + tn, 0), 9) as false_alarm_rate, "
    "round(fn * 1e0 / nullif(fn + tp, 0), 9) as missed_defect_rate from conf", "preds", ctes={"conf": _CONF}))
def m20_confusion_matrix(spark, sf_dir):
    c = EV.confusion_counts(preds(spark, sf_dir))
    return c.select("tp", "fp", "fn", "tn", _r(F.col("false_alarm_rate")).alias("false_alarm_rate"),
                    _r(F.col("missed_defect_rate")).alias("missed_defect_rate"))


_CURVE = ("select score as threshold, pos, neg, sum(pos) over (order by score desc) as tp, "
          "sum(neg) over (order by score desc) as fp, sum(pos) over () as P, sum(neg) over () as N from "
          "(select p as score, sum(y) as pos, sum(1 - y) as neg from preds group by p)")


@register("m21_roc_curve", with_fixtures(
    "select threshold, round(tp * 1e0 / P, 9) as tpr, round(fp * 1e0 / N, 9) as fpr from curve", "preds",
    ctes={"curve": _CURVE}))
def m21_roc_curve(spark, sf_dir):
    r = EV.roc_curve(preds(spark, sf_dir))
    return r.select("threshold", _r(F.col("tpr")).alias("tpr"), _r(F.col("fpr")).alias("fpr"))


@register("m22_pr_curve", with_fixtures(
    "select threshold, round(tp * 1e0 / (tp + fp), 9) as precision, round(tp * 1e0 / P, 9) as recall from curve",
    "preds", ctes={"curve": _CURVE}))
def m22_pr_curve(spark, sf_dir):
    r = EV.pr_curve(preds(spark, sf_dir))
    return r.select("threshold", _r(F.col("precision")).alias("precision"), _r(F.col("recall")).alias("recall"))


@register("m22_average_precision", with_fixtures(
    "select round(sum(pos * 1e0 / P * (tp * 1e0 / (tp + fp))), 9) as average_precision, "
    "arg_min(threshold, (abs(threshold - 5e-1), threshold)) as threshold_near_half from curve", "preds",
    ctes={"curve": _CURVE}))
def m22_average_precision(spark, sf_dir):
    a = EV.average_precision(preds(spark, sf_dir))
    return a.select(_r(F.col("average_precision")).alias("average_precision"), "threshold_near_half")


@register("m23_classification_report", with_fixtures(
    """select label, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, support from (
       select '1' as label, tp*1e0/(tp+fp) as precision, tp*1e0/(tp+fn) as recall,
              2e0*(tp*1e0/(tp+fp))*(tp*1e0/(tp+fn))/((tp*1e0/(tp+fp))+(tp*1e0/(tp+fn))) as f1, tp+fn as support from conf
       union all select '0', tn*1e0/(tn+fn), tn*1e0/(tn+fp),
              2e0*(tn*1e0/(tn+fn))*(tn*1e0/(tn+fp))/((tn*1e0/(tn+fn))+(tn*1e0/(tn+fp))), tn+fp from conf
       union all select 'accuracy', null, null, (tp+tn)*1e0/(tp+fp+fn+tn), tp+fp+fn+tn from conf
       union all select 'macro avg', (tp*1e0/(tp+fp) + tn*1e0/(tn+fn))/2e0, (tp*1e0/(tp+fn) + tn*1e0/(tn+fp))/2e0,
              (2e0*(tp*1e0/(tp+fp))*(tp*1e0/(tp+fn))/((tp*1e0/(tp+fp))+(tp*1e0/(tp+fn)))
               + 2e0*(tn*1e0/(tn+fn))*(tn*1e0/(tn+fp))/((tn*1e0/(tn+fn))+(tn*1e0/(tn+fp))))/2e0, tp+fp+fn+tn from conf
       union all select 'weighted avg',
              ((tn*1e0/(tn+fn))*(tn+fp) + (tp*1e0/(tp+fp))*(tp+fn))/(tp+fp+fn+tn),
              ((tn*1e0/(tn+fp))*(tn+fp) + (tp*1e0/(tp+fn))*(tp+fn))/(tp+fp+fn+tn),
              ((2e0*(tn*1e0/(tn+fn))*(tn*1e0/(tn+fp))/((tn*1e0/(tn+fn))+(tn*1e0/(tn+fp))))*(tn+fp)
               + (2e0*(tp*1e0/(tp+fp))*(tp*1e0/(tp+fn))/((tp*1e0/(tp+fp))+(tp*1e0/(tp+fn))))*(tp+fn))/(tp+fp+fn+tn),
              tp+fp+fn+tn from conf)""", "preds", ctes={"conf": _CONF}))
def m23_classification_report(spark, sf_dir):
    r = EV.classification_report(preds(spark, sf_dir))
    return r.select("label", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("m25_prediction_counts", with_fixtures(
    "select c.yhat, count(p.yhat) as n from (values (0), (1)) c(yhat) left join preds p on p.yhat = c.yhat "
    "group by c.yhat", "preds"))
def m25_prediction_counts(spark, sf_dir):
    pr = preds(spark, sf_dir).groupBy("yhat").agg(F.count(F.lit(1)).alias("n"))
    dim = spark.createDataFrame([(0,), (1,)], "yhat int")
    return dim.join(pr, "yhat", "left").select("yhat", F.coalesce("n", F.lit(0)).alias("n"))


@register("m26_confidence_bands", with_fixtures(
    """select b.band, count(t.band) as n from (values ('0.50-0.65'), ('0.65-0.85'), ('0.85-1.00')) b(band)
       left join (select case when greatest(p, 1e0 - p) >= 5e-1 and greatest(p, 1e0 - p) < 6.5e-1 then '0.50-0.65'
                              when greatest(p, 1e0 - p) >= 6.5e-1 and greatest(p, 1e0 - p) < 8.5e-1 then '0.65-0.85'
                              when greatest(p, 1e0 - p) >= 8.5e-1 and greatest(p, 1e0 - p) <= 1e0 then '0.85-1.00'
                         end as band from preds) t on t.band = b.band group by b.band""", "preds"))
def m26_confidence_bands(spark, sf_dir):
    return EV.confidence_bands(preds(spark, sf_dir))


@register("m27_model_health", with_fixtures(
    """select round(fp * 1e0 / (fp + tn), 9) as false_alarm_rate, round(fn * 1e0 / (fn + tp), 9) as missed_defect_rate,
         round((tp + fn) * 1e0 / n, 9) as defect_share, round(sure * 1e0 / n, 9) as high_confidence_share, unsure as n_low_confidence,
         tp as defects_caught, n - fp as decisions_protected, round(1e0 - fp * 1e0 / (fp + tn), 9) as false_alarm_reduction,
         round(least(9.9e1, (tp * 1e0 / (tp + fp)) * (tp * 1e0 / (tp + fn)) * 1e2), 9) as quality_improvement
       from conf, (select count(*) as n, count(*) filter (where greatest(p, 1e0 - p) >= 8.5e-1) as sure,
                     count(*) filter (where greatest(p, 1e0 - p) < 6.5e-1) as unsure from preds)""", "preds", ctes={"conf": _CONF}))
def m27_model_health(spark, sf_dir):
    h = EV.health_scalars(preds(spark, sf_dir))
    return h.select(*[_r(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in h.dtypes])


_CARDS = {"accuracy": ("(tp + tn) * 1e0 / (tp + tn + fp + fn)", "v"), "precision": ("tp * 1e0 / (tp + fp)", "v"),
          "recall": ("tp * 1e0 / (tp + fn)", "v"), "f1": ("2e0 * tp / (2 * tp + fp + fn)", "v"), "roc_auc": ("(select roc_auc from auc)", "v"),
          "false_alarm_rate": ("fp * 1e0 / (fp + tn)", "1e0 - v"), "missed_defect_rate": ("fn * 1e0 / (fn + tp)", "1e0 - v")}


@register("a40_metric_cards", with_fixtures(
    " union all ".join(f"select '{m}' as metric, round(v, 9) as value, case when {seen} >= {EV.METRIC_BANDS[m][0]:e} then 'good' "
                       f"when {seen} >= {EV.METRIC_BANDS[m][1]:e} then 'warn' else 'poor' end as status from (select {expr} as v from conf)"
                       for m, (expr, seen) in _CARDS.items()), "preds", ctes={"conf": _CONF, "auc": _AUC}))
def a40_metric_cards(spark, sf_dir):
    return EV.metric_cards(preds(spark, sf_dir)).select("metric", _r(F.col("value")).alias("value"), "status")


_SIGNALS = {"probability": "defect_prob", "anomaly": "anomaly_score", "magnesium": "1e0 - least(1e0, mg_recovery_)"}


@register("w7_model_leaderboard", with_fixtures(
    "select model, n, round(accuracy, 9) as accuracy, round(recall, 9) as recall, round(roc_auc, 9) as roc_auc, "
    "row_number() over (order by roc_auc desc, model) as rank, row_number() over (order by roc_auc desc, model) = 1 as selected from ("
    "select model, count(*) as n, avg(case when y = yhat then 1e0 else 0e0 end) as accuracy, sum(y*yhat) * 1e0 / sum(y) as recall, "
    "(sum(rk) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * cast(sum(1 - y) as double)) as roc_auc from ranked group by model)",
    "heats", ctes={
        "scored": " union all ".join(f"select '{m}' as model, defect as y, {p} as p from heats" for m, p in _SIGNALS.items()),
        "ranked": "select *, case when p >= 5e-1 then 1 else 0 end as yhat, rank() over (partition by model order by p) "
                  "+ (count(*) over (partition by model, p) - 1) / 2e0 as rk from scored"}))
def w7_model_leaderboard(spark, sf_dir):
    """The row signals as competing models of the defect label: metrics in one grouped job, ranked, the best marked."""
    from ..operators.training import metrics_by
    h = heats(spark, sf_dir)
    p = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.expr(e).alias("p")) for m, e in _SIGNALS.items()]))
    long = h.select(F.col("defect").alias("y"), p.alias("s")).select("y", "s.*").withColumn("yhat", (F.col("p") >= 0.5).cast("int"))
    board = EV.leaderboard(metrics_by(long, ["model"]))
    return board.select("model", "n", *[_r(F.col(c)).alias(c) for c in ("accuracy", "recall", "roc_auc")], "rank", "selected")


