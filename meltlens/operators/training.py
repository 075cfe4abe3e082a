"""Train, compare, select, persist and reload.

One frame with a split and a fold column is stored; every fit reads it with a
filter, and fits run side by side.  Predictions of all fits stand in one frame,
so all metrics of all models and folds come from one grouped aggregate.

An artefact folder holds versions (model, ordered features, fill values,
metrics).  A version counts once its row stands in the folder's commit table,
which is written last, so a reader sees a whole version or the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..plans.ordered import exact_quantiles, running_totals, with_positions
from ..session import cut_lineage
from ..sources.io import (commit_version, latest_version, load_feature_schema, load_fill_values, new_version, save_feature_schema,
                          save_fill_values)
from . import analytics as AN
from . import evaluation as EV
from . import models as MD
from .upload import Scorer

FOLDS = 5
#: Fits that run side by side; each is a series of small jobs and keeps a copy of its rows, of memory and then of disk.
PARALLEL_FITS = 8
#: Rows of all copies of fits side by side; larger tables are fitted one model after the other.
PARALLEL_ROWS = 8_000_000
METRICS = ["roc_auc", "recall", "f1", "average_precision"]


def side_by_side(tasks: Sequence[Callable[[], object]], rows: int) -> list:
    """Results of independent Spark jobs over ``rows`` rows each, that a pool of threads submits."""
    with ThreadPoolExecutor(max(1, min(PARALLEL_FITS, PARALLEL_ROWS // max(rows, 1)))) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]


def training_frame(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], test_fraction: float = 0.2,
                   folds: int = FOLDS, seed: int = config.SPLIT_SEED) -> DataFrame:
    """Stored keys, features, label and class weight with ``split`` (train or test) and ``fold``, both stratified."""
    narrow = df.select(*dict.fromkeys([*keys, *features, label]))
    ranked = EV.stratified_rank(narrow, label, keys, seed)
    split = F.when(F.col("__rank") <= F.round(F.col("__n") * test_fraction), "test").otherwise("train")
    parted = ranked.withColumns({"split": split, "fold": F.pmod(F.col("__rank") - 1, F.lit(folds)).cast("int")}).drop("__rank", "__n")
    return cut_lineage(MD.with_class_weights(parted, label))


def predictions(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    p = vector_to_array(F.col("probability"))[1]
    return model.transform(df).select(F.col(label).cast("int").alias("y"), p.alias("p"), (p >= 0.5).cast("int").alias("yhat"))


def metrics_by(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per group of ``df(groups, y, p, yhat)``: rows, accuracy, precision, recall, F1, exact ROC AUC and average precision."""
    groups = list(groups)
    counts = df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("P"),
        F.count_if((F.col("y") == 1) & (F.col("yhat") == 1)).alias("tp"), F.count_if((F.col("y") == 0) & (F.col("yhat") == 1)).alias("fp"))
    scores = df.groupBy(*groups, F.col("p").alias("score")).agg(
        F.sum(F.col("y").cast("long")).alias("pos"), F.sum((1 - F.col("y")).cast("long")).alias("neg"))
    both = F.col("pos") + F.col("neg")
    ranked = running_totals(scores, groups, ["score"], {"cum_pos": F.col("pos"), "cum": both}).join(counts.select(*groups, "n", "P"), groups)
    rank = F.col("cum") - both + (both + 1) / 2.0
    # rows at this score or above it
    tp_here, here = F.col("P") - F.col("cum_pos") + F.col("pos"), F.col("n") - F.col("cum") + both
    curves = ranked.groupBy(*groups).agg(F.sum(F.col("pos") * rank).alias("ranks"),
                                         F.sum(F.col("pos") * (tp_here / here)).alias("steps"))
    P, N = F.col("P").cast("double"), (F.col("n") - F.col("P")).cast("double")
    zero = F.lit(0.0)
    precision = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), zero)
    recall = F.coalesce(F.col("tp") / F.nullif(F.col("P"), F.lit(0)), zero)
    return counts.join(curves, groups).select(
        *groups, "n", ((F.col("tp") + N - F.col("fp")) / F.col("n")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        F.coalesce(2 * precision * recall / F.nullif(precision + recall, zero), zero).alias("f1"),
        ((F.col("ranks") - P * (P + 1) / 2) / F.nullif(P * N, zero)).alias("roc_auc"),
        (F.col("steps") / F.nullif(P, zero)).alias("average_precision"))


def compare_models(frame: DataFrame, features: Sequence[str], candidates: dict[str, object], label: str = "defect",
                   folds: int = FOLDS) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Every candidate on the hold-out and in cross-validation over the training rows.

    Leaderboard (best hold-out AUC first, then recall, then name) and the models fitted on all
    training rows.  ``folds`` = 0 leaves the cross-validation out."""
    train = frame.where("split = 'train'")
    runs = [(name, k) for name in candidates for k in range(-1, folds)]

    def fit(name: str, k: int) -> PipelineModel:
        return MD.fit_classifier(train if k < 0 else train.where(F.col("fold") != k), features, candidates[name].copy())

    fitted = dict(zip(runs, side_by_side([lambda r=r: fit(*r) for r in runs], train.count())))
    frames = [predictions(fitted[name, k], frame.where("split = 'test'") if k < 0 else train.where(F.col("fold") == k), label)
              .select(F.lit(name).alias("model"), F.lit(k).alias("fold"), "*") for name, k in runs]
    every = frames[0]
    for more in frames[1:]:
        every = every.unionByName(more)
    scored = metrics_by(cut_lineage(every), ["model", "fold"])
    held = F.col("fold") < 0
    board = scored.groupBy("model").agg(
        *[F.max(F.when(held, F.col(m))).alias(f"test_{m}") for m in METRICS],
        *[f(F.when(~held, F.col(m))).alias(f"cv_{m}_{name}") for m in METRICS[:3] for name, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return board.orderBy(F.desc("test_roc_auc"), F.desc("test_recall"), "model"), {n: fitted[n, -1] for n in candidates}


def out_of_fold(frame: DataFrame, features: Sequence[str], estimator, label: str = "defect") -> DataFrame:
    """``fold, y, p, yhat`` of every row of the table, each scored by a model that has not seen its fold."""
    def run(k: int) -> DataFrame:
        model = MD.fit_classifier(frame.where(F.col("fold") != k), features, estimator.copy())
        return predictions(model, frame.where(F.col("fold") == k), label).select(F.lit(k).alias("fold"), "*")

    folds = sorted(r["fold"] for r in frame.select("fold").distinct().collect())  # as many as the frame was made with
    frames = side_by_side([lambda k=k: run(k) for k in folds], frame.count())
    every = frames[0]
    for more in frames[1:]:
        every = every.unionByName(more)
    return cut_lineage(every)


def validation_report(oof: DataFrame, whole: DataFrame) -> DataFrame:
    """``section, item, metric, value`` - mean and deviation over folds, and the per-class report of ``whole(y, yhat)``."""
    folds = metrics_by(oof, ["fold"])
    stats = folds.agg(*[f(m).alias(f"{m}:{name}") for m in METRICS for name, f in (("mean", F.avg), ("std", F.stddev_pop))])
    cv = stats.select(F.explode(F.array(*[F.struct(F.lit("cross_validation").alias("section"), F.lit(c.split(":")[0]).alias("item"),
                                                   F.lit(c.split(":")[1]).alias("metric"), F.col(f"`{c}`").alias("value"))
                                          for c in stats.columns])).alias("r")).select("r.*")
    report = EV.classification_report(whole)
    per_class = report.select(F.explode(F.array(*[F.struct(F.lit("classification_report").alias("section"), F.col("label").alias("item"),
                                                           F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                                  for c in ("precision", "recall", "f1", "support")])).alias("r")).select("r.*")
    return cv.unionByName(per_class.where("value is not null"))


def fold_spread(oof: DataFrame, metrics: Sequence[str] = ("roc_auc", "recall", "f1")) -> DataFrame:
    """``metric, min, q1, median, q3, max, n`` of the folds' scores, of ``oof(fold, y, p, yhat)``."""
    scores = metrics_by(oof, ["fold"])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in metrics])
    return AN.five_number_summary(scores.select(F.explode(cells).alias("r")).select("r.*").where("score is not null"), "score", "metric")


# ---------------------------------------------------------------------------
# permutation importance
# ---------------------------------------------------------------------------
def shuffled_values(df: DataFrame, columns: Sequence[str], repeats: int, seed: int = config.SPLIT_SEED) -> DataFrame:
    """Every row of ``df`` once for each repeat, with ``repeat`` and another row's values of ``columns`` as struct ``donor``.

    A repeat's permutation is the order of the row positions' seeded hashes, so only (hash, position)
    pairs are sorted, and one join deals out the values."""
    kept = with_positions(df, "__row")
    hashed = kept.select("__row").withColumn("repeat", F.explode(F.array(*[F.lit(r) for r in range(repeats)]))).withColumn(
        "__h", F.xxhash64(F.lit(seed), "repeat", "__row"))
    order = running_totals(hashed, ["repeat"], ["__h", "__row"], {"__to": F.lit(1).cast("long")})
    donors = (kept.select("__row", F.struct(*columns).alias("donor")).join(order, "__row")
              .select("repeat", (F.col("__to") - 1).alias("__row"), "donor"))
    return kept.join(donors, "__row").drop("__row")


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str = "defect", repeats: int = 5,
                           seed: int = config.SPLIT_SEED) -> DataFrame:
    """``feature, importance, deviation``: mean loss of accuracy over ``repeats`` when a feature's values are shuffled.

    A row is scored once for each feature and repeat, in one pass over all of them."""
    narrow = df.select(*features, F.col(label).cast("int").alias("__y"))
    base = model.transform(narrow).agg(F.avg((F.col("prediction") == F.col("__y")).cast("double")).alias("base"))
    mixed = shuffled_values(narrow, features, repeats, seed).withColumn("__f", F.explode(F.array(*[F.lit(i) for i in range(len(features))])))
    swapped = mixed.select("__y", "repeat", "__f", *[F.when(F.col("__f") == i, F.col(f"donor.{c}")).otherwise(F.col(c)).alias(c)
                                                     for i, c in enumerate(features)])
    scored = model.transform(swapped).groupBy("__f", "repeat").agg(F.avg((F.col("prediction") == F.col("__y")).cast("double")).alias("score"))
    loss = scored.crossJoin(F.broadcast(base)).select("__f", (F.col("base") - F.col("score")).alias("loss"))
    names = F.array(*[F.lit(f) for f in features])
    return loss.groupBy("__f").agg(F.avg("loss").alias("importance"), F.stddev_pop("loss").alias("deviation")).select(
        F.element_at(names, F.col("__f") + 1).alias("feature"), "importance", "deviation")


def importance_frame(model: PipelineModel, features: Sequence[str], test: DataFrame | None = None, label: str = "defect") -> DataFrame:
    """``feature, importance, method`` - the model's importances, else absolute coefficients, else permutation on
    ``test`` (not empty), else zeros."""
    spark, last = SparkSession.getActiveSession(), model.stages[-1]
    if hasattr(last, "featureImportances") or hasattr(last, "coefficients"):
        method = "importances" if hasattr(last, "featureImportances") else "coefficients"
        return spark.createDataFrame([(f, float(v), method) for f, v in MD.feature_importance(model, features)],
                                     "feature string, importance double, method string")
    if test is not None and not test.isEmpty():
        return permutation_importance(model, test, features, label).select("feature", "importance", F.lit("permutation").alias("method"))
    return spark.createDataFrame([(f, 0.0, "unavailable") for f in features], "feature string, importance double, method string")


# ---------------------------------------------------------------------------
# artefacts
# ---------------------------------------------------------------------------
def training_medians(frame: DataFrame, features: Sequence[str]) -> dict[str, float]:
    found = {r["column"]: r["value"] for r in exact_quantiles(frame, list(features), [0.5]).collect()}  # one row per feature
    return {f: float(found.get(f) or 0.0) for f in features}


def save_artefact(spark: SparkSession, path: str, name: str, model: PipelineModel, features: Sequence[str], fill: dict[str, float],
                  metrics: DataFrame | None = None) -> str:
    """Write a version, then its row of the commit table.  Returns the version's folder."""
    version = new_version(path)
    model.write().save(f"{version}/model")
    save_feature_schema(spark, list(features), f"{version}/features")
    save_fill_values(spark, fill, f"{version}/fill")
    if metrics is not None:
        metrics.write.parquet(f"{version}/metrics")
    commit_version(spark, path, version, name)
    return version


def load_scorer(spark: SparkSession, path: str, outputs: Callable[[DataFrame], dict]) -> Scorer | None:
    """The latest version as a scorer; ``outputs`` names the columns to add from the model's output.  None if there is none."""
    found = latest_version(spark, path)
    if found is None:
        return None
    model = PipelineModel.load(f"{found[0]}/model")
    made = {c for stage in model.stages for c in (stage.getOrDefault(p) for p in stage.params if p.name.endswith("Col") and p.name != "weightCol"
                                                   and p.name != "labelCol" and stage.isDefined(p)) if isinstance(c, str) and c}

    def score(df: DataFrame) -> DataFrame:
        # columns of the upload with the names of the model's own are set aside
        aside = {c: f"__aside_{c}" for c in df.columns if c in made}
        scored = model.transform(df.withColumnsRenamed(aside))
        added = scored.withColumns(outputs(scored))
        return added.drop(*made).withColumnsRenamed({v: k for k, v in aside.items()})

    return Scorer(load_feature_schema(spark, f"{found[0]}/features"), load_fill_values(spark, f"{found[0]}/fill"), score)


def probability_scorer(spark: SparkSession, path: str) -> Scorer | None:
    """Adds ``defect_prob``, the probability of class 1."""
    return load_scorer(spark, path, lambda _: {"defect_prob": vector_to_array(F.col("probability"))[1]})


def train_and_save(spark: SparkSession, df: DataFrame, features: Sequence[str], keys: Sequence[str], path: str,
                   candidates: Callable[[int], dict[str, object]] = MD.candidates, label: str = "defect", folds: int = FOLDS,
                   frame: DataFrame | None = None) -> DataFrame:
    """Compare, select and persist; the leaderboard, read back from the saved version.

    ``frame``: the training frame of ``df`` where the caller has stored it already."""
    if frame is None:
        frame = training_frame(df, features, label, keys, folds=max(folds, 1))
    train = frame.where("split = 'train'")
    board, models = compare_models(frame, features, candidates(train.count()), label, folds)
    board = cut_lineage(board)
    best = board.orderBy(F.desc("test_roc_auc"), F.desc("test_recall"), "model").head()["model"]
    version = save_artefact(spark, path, best, models[best], features, training_medians(train, features), board)
    return spark.read.parquet(f"{version}/metrics").withColumn("selected", F.col("model") == best)
