"""Model evaluation over a predictions frame ``(key..., y, p, yhat)``.

Every metric is an aggregate; curve and rank metrics pre-aggregate by
distinct score first and then use hot-key-safe running totals, so no window
ever collapses the table into one partition.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lookup import materialize_if_small
from ..plans.ordered import join_on_keys, running_totals


def split_hash(keys: Sequence[str], seed: int = 42) -> Column:
    """Deterministic pseudo-random order key computable in any SQL engine."""
    h = F.lit(seed)
    mults = [2654435761, 40503, 97, 1]
    for i, k in enumerate(keys):
        # reduced first: the product of a large key would overflow
        h = h + F.pmod(F.col(k).cast("long"), F.lit(1000003)) * mults[i % len(mults)]
    return F.pmod(h, F.lit(1000003))


def stratified_rank(df: DataFrame, label: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Position of each row inside its class in hash order (+ class size)."""
    h = df.withColumn("__h", split_hash(keys, seed))
    ranked = running_totals(h, [label], ["__h", *keys], {"__rank": F.lit(1).cast("long")})
    sizes = ranked.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))  # one row per class, of the rows that are stored by now
    small, fits = materialize_if_small(sizes)
    return join_on_keys(ranked, F.broadcast(small) if fits else small, [label]).drop("__h")


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """M1: ``split`` = test for the first round(test_fraction * n_c) rows of each class."""
    r = stratified_rank(df, label, keys, seed)
    cut = F.round(F.col("__n") * test_fraction)
    return r.withColumn("split", F.when(F.col("__rank") <= cut, "test").otherwise("train")).drop("__rank", "__n")


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """M2: ``fold`` = (position - 1) mod k inside each class."""
    r = stratified_rank(df, label, keys, seed)
    return r.withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank", "__n")


def confusion_counts(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Tp / fp / fn / tn and the false-alarm / missed-defect rates."""
    Y, P = F.col(y), F.col(yhat)
    c = df.agg(F.count_if((Y == 1) & (P == 1)).alias("tp"), F.count_if((Y == 0) & (P == 1)).alias("fp"),
               F.count_if((Y == 1) & (P == 0)).alias("fn"), F.count_if((Y == 0) & (P == 0)).alias("tn"))
    return c.withColumns({
        "false_alarm_rate": F.col("fp") / F.nullif(F.col("fp") + F.col("tn"), F.lit(0)),
        "missed_defect_rate": F.col("fn") / F.nullif(F.col("fn") + F.col("tp"), F.lit(0)),
    })


def score_table(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Distinct scores with positive / negative counts (map-side combined)."""
    return df.groupBy(F.col(p).alias("score")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum((1 - F.col(y)).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Exact ROC AUC by the rank-sum statistic with tied scores averaged."""
    s = score_table(df, y, p)
    r = running_totals(s, [], ["score"], {"cum": F.col("pos") + F.col("neg")})
    avg_rank = F.col("cum") - (F.col("pos") + F.col("neg")) + (F.col("pos") + F.col("neg") + 1) / 2.0
    agg = r.agg(F.sum(F.col("pos") * avg_rank).alias("s"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    P, N = F.col("P").cast("double"), F.col("N").cast("double")  # their products exceed a long
    return agg.select(((F.col("s") - P * (P + 1) / 2.0) / F.nullif(P * N, F.lit(0.0))).alias("roc_auc"))


def classification_metrics(df: DataFrame, y: str = "y", p: str = "p", yhat: str = "yhat") -> DataFrame:
    """Accuracy, precision, recall, F1 and ROC AUC in one row."""
    c = confusion_counts(df, y, yhat)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec = F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0))
    rec = F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(0.0))
    m = c.select(((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
                 F.coalesce(2 * prec * rec / F.nullif(prec + rec, F.lit(0.0)), F.lit(0.0)).alias("f1"))
    return m.crossJoin(roc_auc(df, y, p))  # two one-row frames


def curve_points(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """M21 / M22 base: per distinct threshold (descending) cumulative tp / fp."""
    s = score_table(df, y, p).withColumn("neg_score", -F.col("score"))
    r = running_totals(s, [], ["neg_score"], {"tp": F.col("pos"), "fp": F.col("neg")})
    tot = s.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return r.crossJoin(tot).select(F.col("score").alias("threshold"), "pos", "neg", "tp", "fp", "P", "N")


def roc_curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    c = curve_points(df, y, p)
    return c.select("threshold", (F.col("tp") / F.col("P")).alias("tpr"), (F.col("fp") / F.col("N")).alias("fpr"))


def pr_curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    c = curve_points(df, y, p)
    return c.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    (F.col("tp") / F.col("P")).alias("recall"), "pos", "P")


def average_precision(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Step-sum AP = sum over thresholds of (recall gain) x precision, plus
    the threshold nearest to 0.5."""
    c = pr_curve(df, y, p)
    return c.agg(F.sum(F.col("pos") / F.col("P") * F.col("precision")).alias("average_precision"),
                 F.min_by("threshold", F.struct(F.abs(F.col("threshold") - 0.5), F.col("threshold")))
                 .alias("threshold_near_half"))


def classification_report(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted averages."""
    c = confusion_counts(df, y, yhat).first()
    tp, fp, fn, tn = c["tp"], c["fp"], c["fn"], c["tn"]
    spark = df.sparkSession

    def prf(t, f_p, f_n):
        pr = t / (t + f_p) if t + f_p else 0.0
        rc = t / (t + f_n) if t + f_n else 0.0
        f1 = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
        return pr, rc, f1

    p1 = prf(tp, fp, fn)
    p0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    rows = [("0", *p0, s0), ("1", *p1, s1),
            ("accuracy", None, None, (tp + tn) / n if n else 0.0, n),
            ("macro avg", (p0[0] + p1[0]) / 2, (p0[1] + p1[1]) / 2, (p0[2] + p1[2]) / 2, n),
            ("weighted avg", (p0[0] * s0 + p1[0] * s1) / n, (p0[1] * s0 + p1[1] * s1) / n,
             (p0[2] * s0 + p1[2] * s1) / n, n)]
    return spark.createDataFrame(rows, "label string, precision double, recall double, f1 double, support long")


def confidence_bands(df: DataFrame, p: str = "p", edges: Sequence[float] = (0.5, 0.65, 0.85, 1.0)) -> DataFrame:
    """Confidence max(p, 1-p) in left-closed bands, zero-filled."""
    conf = F.greatest(F.col(p), 1 - F.col(p))
    labels = [f"{edges[i]:.2f}-{edges[i + 1]:.2f}" for i in range(len(edges) - 1)]
    band = None
    for i in range(len(edges) - 1):
        cond = (conf >= edges[i]) & ((conf < edges[i + 1]) if i < len(edges) - 2 else (conf <= edges[i + 1]))
        band = F.when(cond, labels[i]) if band is None else band.when(cond, labels[i])
    counts = df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    dim = df.sparkSession.createDataFrame([(b,) for b in labels], "band string")  # fixed labels
    return dim.join(counts, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


def health_scalars(df: DataFrame, y: str = "y", p: str = "p", yhat: str = "yhat") -> DataFrame:
    """One row of model health and business impact, from one aggregate.

    Error rates, defect share, shares of sure (0.85 or more) and counts of unsure (below 0.65) predictions, defects caught,
    decisions that are no false alarm, the share of sound batches left alone, and precision times recall in percent, at most 99."""
    conf = F.greatest(F.col(p), 1 - F.col(p))
    c = confusion_counts(df, y, yhat).crossJoin(df.agg(  # two one-row frames
        F.avg((F.col(y) == 1).cast("double")).alias("defect_share"), F.avg((conf >= 0.85).cast("double")).alias("high_confidence_share"),
        F.count_if(conf < 0.65).alias("n_low_confidence"), F.count(F.lit(1)).alias("n")))
    zero = F.lit(0)
    precision = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), zero), F.lit(0.0))
    recall = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), zero), F.lit(0.0))
    return c.select("false_alarm_rate", "missed_defect_rate", F.coalesce("defect_share", F.lit(0.0)).alias("defect_share"),
                    F.coalesce("high_confidence_share", F.lit(0.0)).alias("high_confidence_share"), "n_low_confidence",
                    F.col("tp").alias("defects_caught"), F.greatest(zero, F.greatest(F.col("n"), F.lit(1)) - F.col("fp")).alias("decisions_protected"),
                    (1 - F.coalesce("false_alarm_rate", F.lit(0.0))).alias("false_alarm_reduction"),
                    F.least(F.lit(99.0), precision * recall * 100.0).alias("quality_improvement"))


# FIXED VALUES - (good, warn) of every metric card
METRIC_BANDS = {"accuracy": (0.85, 0.75), "precision": (0.85, 0.70), "recall": (0.85, 0.70), "f1": (0.85, 0.70), "roc_auc": (0.85, 0.75),
                "false_alarm_rate": (0.9, 0.8), "missed_defect_rate": (0.9, 0.8)}


def status_band(value: Column, good: float, warn: float) -> Column:
    """Good, warn or poor; no value counts as poor."""
    return F.when(value >= good, "good").when(value >= warn, "warn").otherwise("poor")


def metric_cards(df: DataFrame, y: str = "y", p: str = "p", yhat: str = "yhat") -> DataFrame:
    """``metric, value, status`` of the model's cards; error rates are banded by what they leave."""
    rates = confusion_counts(df, y, yhat).select("false_alarm_rate", "missed_defect_rate")
    row = classification_metrics(df, y, p, yhat).crossJoin(rates)  # one-row frames
    cells = []
    for name, (good, warn) in METRIC_BANDS.items():
        seen = 1 - F.col(name) if name.endswith("_rate") else F.col(name)
        cells.append(F.struct(F.lit(name).alias("metric"), F.col(name).alias("value"), status_band(seen, good, warn).alias("status")))
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def leaderboard(scores: DataFrame, by: str = "roc_auc", name: str = "model") -> DataFrame:
    """``rank`` and ``selected`` of every model (a row each), best first, missing scores last, ties by name."""
    order = Window.orderBy(F.desc_nulls_last(by), name)  # as many rows as there are models
    return scores.withColumn("rank", F.row_number().over(order)).withColumn("selected", F.col("rank") == 1)
