"""Forests and boosted trees over binned rows, against Spark's own fit and brute force."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from meltlens.operators import forests as FO
from meltlens.operators import models as MD
from meltlens.session import ship_package

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def rows(spark):
    """Few values a column, so bins are the values; d is the same everywhere."""
    rng = np.random.default_rng(4)
    a, b, c = rng.integers(0, 20, 3000), rng.integers(0, 9, 3000), rng.integers(0, 2, 3000)
    y = (a + 2 * b * c + rng.normal(size=3000) * 4 > 15).astype(int)
    data = [(float(a[i]), float(b[i]), float(c[i]), 1.0, int(y[i])) for i in range(3000)]
    return MD.with_class_weights(spark.createDataFrame(data, "a double, b double, c double, d double, defect int")).repartition(4).cache()


def spark_fit(rows, estimator):
    return Pipeline(stages=[MD.assembler(FEATURES), MD.scaler(), estimator]).fit(rows)


def probabilities(model, rows):
    return np.array([r.p for r in model.transform(rows).select(*FEATURES, vector_to_array("probability")[1].alias("p")).orderBy(*FEATURES).collect()])


def test_fit_does_not_run_sparks_trees(rows, monkeypatch):
    """Spark's forest keeps a counter for each row and tree."""
    def refused(self, _):
        raise AssertionError("Spark's own fit")

    monkeypatch.setattr(FO.RandomForestClassifier, "_fit", refused)
    monkeypatch.setattr(FO.GBTClassifier, "_fit", refused)
    found = MD.candidates(3000, trees=3, rounds=2)
    for name in ("random_forest", "randomized_forest", "gradient_boosting"):
        model = MD.fit_classifier(rows, FEATURES, found[name])
        assert model.stages[-1].getNumTrees == (2 if name == "gradient_boosting" else 3)


def test_trees_without_chance_are_sparks(rows, tmp_path):
    """Without bootstrap and with all features at every node, there is one forest for the rows."""
    estimator = MD.candidates(3000, trees=2)["randomized_forest"].copy().setFeatureSubsetStrategy("all").setMaxDepth(6)
    ours, theirs = MD.fit_classifier(rows, FEATURES, estimator), spark_fit(rows, estimator)
    assert ours.stages[-1].totalNumNodes == theirs.stages[-1].totalNumNodes > 20
    assert np.allclose(probabilities(ours, rows), probabilities(theirs, rows))
    assert np.allclose(ours.stages[-1].featureImportances.toArray(), theirs.stages[-1].featureImportances.toArray(), atol=1e-6)
    ours.write().save(str(tmp_path / "model"))
    assert np.allclose(probabilities(PipelineModel.load(str(tmp_path / "model")), rows), probabilities(ours, rows))


@pytest.mark.parametrize("depth", [1, 3])
def test_boosting_without_chance_is_sparks(rows, depth, monkeypatch):
    monkeypatch.setattr(FO, "STORED_ROUNDS", 3)  # margins are stored on the way
    estimator = MD.candidates(3000, rounds=5, step=0.3)["gradient_boosting"].copy().setSubsamplingRate(1.0).setMaxDepth(depth)
    ours, theirs = MD.fit_classifier(rows, FEATURES, estimator), spark_fit(rows, estimator)
    assert ours.stages[-1].treeWeights == theirs.stages[-1].treeWeights
    assert np.allclose(probabilities(ours, rows), probabilities(theirs, rows), atol=1e-6)


def test_forest_in_many_passes_is_the_same(rows, monkeypatch):
    estimator = MD.candidates(3000, trees=4)["random_forest"].copy().setMaxDepth(5)
    at_once = probabilities(MD.fit_classifier(rows, FEATURES, estimator), rows)
    monkeypatch.setattr(FO, "CELLS", 1)  # one tree at a time
    assert np.allclose(at_once, probabilities(MD.fit_classifier(rows, FEATURES, estimator), rows))
    y = np.array([r.defect for r in rows.orderBy(*FEATURES).collect()])
    assert ((at_once >= 0.5) == y).mean() > 0.75


def test_bootstrap_draws_each_row_once_on_average():
    drawn = FO.bootstrap_counts(42, 3, 7, 200_000)
    assert drawn.mean() == pytest.approx(1.0, abs=0.02) and (drawn == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert (drawn == FO.bootstrap_counts(42, 3, 7, 200_000)).all() and (drawn != FO.bootstrap_counts(42, 4, 7, 200_000)).any()


def test_thresholds_cut_equal_shares():
    assert FO.thresholds(np.array([1.0, 3.0, 3.0]), 32).tolist() == [2.0]
    assert not len(FO.thresholds(np.array([5.0, 5.0]), 32))
    x = np.random.default_rng(0).exponential(size=10_000)
    shares = np.bincount(np.searchsorted(FO.thresholds(x, 32), x))
    assert len(shares) == 32 and shares.min() > 300 and shares.max() < 330


def test_rows_weighted_beyond_their_class_take_sparks_fit(rows):
    estimator = MD.candidates(3000, trees=2)["random_forest"]
    uneven = rows.withColumn("weight", F.col("weight") + F.col("a"))
    assert FO.class_weights(rows, estimator) is not None and FO.class_weights(uneven, estimator) is None
    assert MD.fit_classifier(uneven, FEATURES, estimator).stages[-1].getNumTrees == 2


def test_missing_features_are_refused(rows):
    with pytest.raises(Exception, match="must not be missing"):
        MD.fit_classifier(rows.withColumn("d", F.when(F.col("a") > 3, 1.0)), FEATURES, MD.candidates(3000, trees=2)["random_forest"])


def test_validation_takes_all_four_candidates(spark, monkeypatch):
    from meltlens.catalog import models as M
    from meltlens.operators import training as TR
    seen = []
    real = TR.compare_models
    monkeypatch.setattr(TR, "compare_models", lambda frame, features, candidates, *a: seen.extend(candidates) or real(frame, features, {
        "logistic_regression": candidates["logistic_regression"].copy().setMaxIter(1)}, *a))
    monkeypatch.setattr(TR, "out_of_fold", lambda *a: (_ for _ in ()).throw(KeyError("seen enough")))
    with pytest.raises(KeyError, match="seen enough"):
        M.m28_cross_validation(spark, "/root/testdata/sf0.001")
    assert set(seen) == {"logistic_regression", "random_forest", "gradient_boosting", "randomized_forest"}
