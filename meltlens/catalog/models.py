"""Model entries (rows-only checks: fitted models have no SQL twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering as CL
from ..operators import evaluation as EV
from ..operators import models as MD
from ..operators import training as TR
from ..plans.registry import register
from ..sources.fixtures import HEAT_KEY, heats, with_fixtures
from ..sources.io import scratch_path
from .core import featured, spread_features

MODEL_FEATURES = ["c_", "si_", "s_", "mn_", "p__", "n__", "al__", "mg_", "cr_", "mg_recovery_", "tapping_temp",
                  "pouring_temp", "crca", "fsmaddition_mt", "heel", "tapped_wt_", "feat_ce_calculated",
                  "feat_temp_loss", "feat_shrinkage_risk_index", "feat_gas_risk_index", "feat_chemistry_instability"]


def _split(spark, sf_dir):
    frame = TR.training_frame(spread_features(spark, sf_dir), MODEL_FEATURES, "defect", HEAT_KEY)
    return frame.where("split = 'train'"), frame.where("split = 'test'")


def _model_metrics(name):
    def q(spark, sf_dir):
        train, test = _split(spark, sf_dir)
        est = MD.candidates(train.count())[name]
        model = MD.fit_classifier(train, MODEL_FEATURES, est)
        return EV.classification_metrics(MD.score(model, test, HEAT_KEY)).withColumn("model", F.lit(name))
    return q


register("m5_logistic_regression")(_model_metrics("logistic_regression"))
register("m6_random_forest")(_model_metrics("random_forest"))
register("m7_gradient_boosting")(_model_metrics("gradient_boosting"))
register("m8_randomized_forest")(_model_metrics("randomized_forest"))


@register("m4_class_weights", with_fixtures(
    "select defect, (select count(*) from heats) / (2e0 * count(*)) as weight, count(*) as n from heats group by defect", "heats"))
def m4_class_weights(spark, sf_dir):
    return MD.with_class_weights(featured(spark, sf_dir)).groupBy("defect").agg(
        F.first("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


#: Sizes of the ensembles and k-means restarts where many models are fitted in one entry (m5 to m8 have the full ones).
_TREES, _ROUNDS, _STEP, _RESTARTS = 20, 20, 0.2, 3


def _small_candidates(n_train: int) -> dict:
    return MD.candidates(n_train, trees=_TREES, rounds=_ROUNDS, step=_STEP)


def _quick_candidates(n_train: int) -> dict:
    return {k: v for k, v in _small_candidates(n_train).items() if k in ("logistic_regression", "random_forest")}


@register("m16_scored_probability")
def m16_scored_probability(spark, sf_dir):
    """Every batch scored by a model that was selected, saved and loaded again."""
    path = scratch_path(spark, "classifier")
    TR.train_and_save(spark, featured(spark, sf_dir), MODEL_FEATURES, HEAT_KEY, path, _quick_candidates, folds=0)
    scored = TR.probability_scorer(spark, path).apply(featured(spark, sf_dir).drop("defect_prob"))
    p = F.col("defect_prob")
    return scored.select(*HEAT_KEY, F.col("defect").alias("y"), p.alias("p"), (p >= 0.5).cast("int").alias("yhat"))


@register("m16_m17_upload_without_signals")
def m16_m17_upload_without_signals(spark, sf_dir):
    """D11 for an upload that carries no signals: probability and cluster come from saved artefacts."""
    from ..operators.upload import Artefacts, prepare_upload

    f = spread_features(spark, sf_dir)
    classifier, clusters = scratch_path(spark, "classifier"), scratch_path(spark, "clusters")
    TR.train_and_save(spark, f, MODEL_FEATURES, HEAT_KEY, classifier, _quick_candidates, folds=0)
    CL.fit_and_save(f, MODEL_FEATURES, clusters, k=4, restarts=1)
    art = Artefacts(probability=TR.probability_scorer(spark, classifier), clusters=CL.cluster_scorer(spark, clusters))
    upload = heats(spark, sf_dir).drop("defect_prob", "anomaly_score", "cluster", "l_shipdate")
    decided = prepare_upload(upload, art, HEAT_KEY)
    return decided.groupBy("cluster", "risk_level", "recommendation").agg(
        F.count("*").alias("n"), F.avg("defect_prob").alias("mean_prob"), F.max("defect_prob").alias("max_prob"))


@register("m24_feature_importance")
def m24_feature_importance(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    model = MD.fit_classifier(train, MODEL_FEATURES, MD.candidates(1)["random_forest"])
    df = TR.importance_frame(model, MODEL_FEATURES)
    label = F.initcap(F.trim(F.regexp_replace(F.regexp_replace("feature", "^feat_", ""), "_", " ")))
    return df.orderBy(F.desc("importance"), "feature").limit(15).withColumn("label", label)


@register("m24_permutation_importance")
def m24_permutation_importance(spark, sf_dir):
    """Loss of accuracy on the hold-out with a column shuffled, over five repeats."""
    frame = TR.training_frame(featured(spark, sf_dir), MODEL_FEATURES, "defect", HEAT_KEY)
    model = MD.fit_classifier(frame.where("split = 'train'"), MODEL_FEATURES, _small_candidates(1)["random_forest"])
    return TR.permutation_importance(model, frame.where("split = 'test'"), MODEL_FEATURES)


@register("m9_pca_explained_variance")
def m9_pca_explained_variance(spark, sf_dir):
    f = featured(spark, sf_dir)
    _base, _m, ev, k = MD.pca_fit(f, MODEL_FEATURES)
    rows, cum = [], 0.0
    for i, v in enumerate(ev[:25]):
        cum += v
        rows.append((i + 1, float(v), float(cum), i + 1 == k))
    return spark.createDataFrame(rows, "component int, explained double, cumulative double, chosen boolean")


@register("m10_kmeans_sweep")
def m10_kmeans_sweep(spark, sf_dir):
    """Lowest cost of the restarts and sampled Euclidean silhouette for each k; the chosen k is marked."""
    rows, _base, _pca = CL.project(spread_features(spark, sf_dir).select(*MODEL_FEATURES), MODEL_FEATURES)
    found = CL.sweep(rows.select("__id", "pcs"), "__id", restarts=_RESTARTS)
    return spark.createDataFrame(found, "k int, inertia double, silhouette double, chosen boolean")


@register("m17_pca_cluster_scoring")
def m17_pca_cluster_scoring(spark, sf_dir):
    """Every batch scored by the saved clustering chain, with k from the sweep."""
    f, path = spread_features(spark, sf_dir), scratch_path(spark, "clusters")
    CL.fit_and_save(f, MODEL_FEATURES, path, restarts=_RESTARTS)
    scored = CL.cluster_scorer(spark, path).apply(f.drop("cluster"))
    return scored.select(*HEAT_KEY, F.col("cluster").alias("cluster_id"), "pca_pc1", "pca_pc2")


@register("m30_cluster_profile_job")
def m30_cluster_profile_job(spark, sf_dir):
    """The whole job: k from the sweep, k-means and DBSCAN labels, artefact, and a profile of each cluster."""
    labelled, _found = CL.cluster_job(spread_features(spark, sf_dir), MODEL_FEATURES, scratch_path(spark, "clusters"), _RESTARTS, _RESTARTS)
    return CL.cluster_profile(labelled, MODEL_FEATURES).withColumnRenamed("cluster", "cluster_id")


@register("m18_model_leaderboard")
def m18_model_leaderboard(spark, sf_dir):
    """All four candidates on the hold-out and in five folds; the best is saved, and the table is read back from its folder."""
    return TR.train_and_save(spark, featured(spark, sf_dir), MODEL_FEATURES, HEAT_KEY, scratch_path(spark, "classifier"), _small_candidates)


@register("m28_cross_validation")
def m28_cross_validation(spark, sf_dir):
    """Mean and deviation over folds of the one of all four candidates with the best hold-out AUC, and its report on the whole table."""
    f, path = featured(spark, sf_dir), scratch_path(spark, "classifier")
    frame = TR.training_frame(f, MODEL_FEATURES, "defect", HEAT_KEY)
    best = TR.train_and_save(spark, f, MODEL_FEATURES, HEAT_KEY, path, _small_candidates, folds=0,
                             frame=frame).where("selected").head()["model"]
    oof = TR.out_of_fold(frame, MODEL_FEATURES, _small_candidates(frame.count())[best])
    p = F.col("defect_prob")
    scored = TR.probability_scorer(spark, path).apply(frame)
    return TR.validation_report(oof, scored.select(F.col("defect").alias("y"), (p >= 0.5).cast("int").alias("yhat")))
