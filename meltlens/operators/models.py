"""Supervised, projection and clustering models on Spark ML.

Fitting is distributed by Spark ML; every metric is computed with the exact
aggregate operators of :mod:`meltlens.operators.evaluation` on the scored
frame.  Class weights (M4) come from a one-row-per-class aggregate.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..plans.lookup import attach
from . import evaluation as EV
from .forests import fit_trees


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features_raw", handleInvalid="keep")


def scaler() -> StandardScaler:
    """M3: standardisation fitted on the training split only (inside the Pipeline)."""
    return StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True)


def with_class_weights(df: DataFrame, label: str = "defect", name: str = "weight") -> DataFrame:
    """M4: balanced weights n / (2 * n_class) via a per-class aggregate (broadcast behind a size check)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    w = counts.crossJoin(total).select(label, (F.col("__n") / (2.0 * F.col("__nc"))).alias(name))
    return attach(df, w, label, how="inner")


def candidates(n_train: int, seed: int = config.SPLIT_SEED, trees: int = 300, rounds: int = 300, step: float = 0.05) -> dict[str, object]:
    """M5-M8, by default with the reference hyper-parameters; ``trees``, ``rounds`` and ``step`` size the ensembles."""
    return {
        "logistic_regression": LogisticRegression(
            featuresCol="features", labelCol="defect", weightCol="weight", maxIter=2000,
            regParam=1.0 / (0.5 * max(n_train, 1)), elasticNetParam=0.0, standardization=False),
        "random_forest": RandomForestClassifier(
            featuresCol="features", labelCol="defect", weightCol="weight", numTrees=trees, maxDepth=12,
            minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=seed),
        "gradient_boosting": GBTClassifier(
            featuresCol="features", labelCol="defect", maxIter=rounds, stepSize=step, maxDepth=5,
            subsamplingRate=0.8, seed=seed),
        "randomized_forest": RandomForestClassifier(
            featuresCol="features", labelCol="defect", weightCol="weight", numTrees=trees, maxDepth=12,
            minInstancesPerNode=5, featureSubsetStrategy="sqrt", bootstrap=False, seed=seed),
    }


def fit_classifier(train: DataFrame, features: Sequence[str], estimator) -> PipelineModel:
    """Forests and boosted trees are grown over binned rows (:mod:`meltlens.operators.forests`), with Spark's own fit where that
    does not take their settings or labels.

    Fitted on as many partitions as there are cores: for each group of tree nodes every partition sends statistics of all
    nodes of the group, whatever it holds, so more partitions only send more."""
    train = train.coalesce(max(1, train.sparkSession.sparkContext.defaultParallelism))
    if isinstance(estimator, (RandomForestClassifier, GBTClassifier)):
        base = Pipeline(stages=[assembler(features), scaler()]).fit(train)
        trees = fit_trees(base.transform(train), estimator)
        if trees is not None:
            return PipelineModel([*base.stages, trees])
    return Pipeline(stages=[assembler(features), scaler(), estimator]).fit(train)


def score(model: PipelineModel, df: DataFrame, keys: Sequence[str], label: str = "defect") -> DataFrame:
    """``p`` = probability of class 1, ``yhat`` = p >= 0.5."""
    out = model.transform(df)
    p = vector_to_array(F.col("probability"))[1]
    return out.select(*keys, F.col(label).alias("y"), p.alias("p"), (p >= 0.5).cast("int").alias("yhat"))


def leaderboard(train: DataFrame, test: DataFrame, features: Sequence[str], keys: Sequence[str],
                names: Sequence[str] | None = None) -> DataFrame:
    """Fit every candidate, evaluate on the hold-out, sort by test AUC."""
    n_train = train.count()
    cands = candidates(n_train)
    rows = None
    for name in names or list(cands):
        model = fit_classifier(train, features, cands[name])
        m = EV.classification_metrics(score(model, test, keys)).withColumn("model", F.lit(name))
        rows = m if rows is None else rows.unionByName(m)
    return rows.orderBy(F.desc("roc_auc"), "model")


def feature_importance(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Model importances, else |coefficients| (small metadata vector)."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray().tolist()
    elif hasattr(last, "coefficients"):
        vals = [abs(v) for v in last.coefficients.toArray().tolist()]
    else:
        vals = [0.0] * len(features)
    return list(zip(features, vals))


def pca_fit(df: DataFrame, features: Sequence[str], variance: float = config.PCA_VARIANCE_TARGET):
    """M9: full PCA on standardised features, then the smallest k reaching ``variance``."""
    base = Pipeline(stages=[assembler(features), scaler()]).fit(df)
    scaled = base.transform(df)
    full = PCA(k=len(features), inputCol="features", outputCol="pcs").fit(scaled)
    ev = full.explainedVariance.toArray().tolist()
    cum, k = 0.0, len(ev)
    for i, v in enumerate(ev):
        cum += v
        if cum >= variance:
            k = i + 1
            break
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(scaled)
    return base, model, ev, k


def kmeans_sweep(df: DataFrame, features_col: str = "pcs", k_range=config.KMEANS_K_RANGE, seed: int = 42):
    """Inertia and silhouette for k in range; best k by silhouette."""
    ev = ClusteringEvaluator(featuresCol=features_col, predictionCol="cluster", distanceMeasure="squaredEuclidean")
    out = []
    for k in range(k_range[0], k_range[1] + 1):
        model = KMeans(k=k, seed=seed, featuresCol=features_col, predictionCol="cluster", maxIter=50).fit(df)
        pred = model.transform(df)
        out.append((k, float(model.summary.trainingCost), float(ev.evaluate(pred))))
    return out
