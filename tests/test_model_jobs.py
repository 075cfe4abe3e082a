"""Training, clustering and permutation jobs against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from meltlens.operators import clustering as CL
from meltlens.operators import evaluation as EV
from meltlens.operators import models as MD
from meltlens.operators import training as TR
from meltlens.plans.ordered import attach_by_position, with_positions
from meltlens.session import ship_package
from meltlens.sources import io as IO


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def labelled(spark):
    """a decides the label, b is noise, c is constant."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=600), rng.normal(size=600)
    y = (a + 0.3 * rng.normal(size=600) > 0.4).astype(int)
    rows = [(i, float(a[i]), float(b[i]), 1.0, int(y[i])) for i in range(600)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, defect int").repartition(5).cache()


def small(n):
    found = MD.candidates(n, trees=5, rounds=3, step=0.3)
    return {k: found[k] for k in ("logistic_regression", "random_forest")}


def test_positional_attach_merges_and_deals_equal_values(spark, tmp_path):
    """Neither whole side is broadcast, however small it is estimated; rows of one probability keep their keys."""
    from meltlens.catalog.analytics import j3_positional_attach

    spark.range(3000).selectExpr("id as l_orderkey", "1L as l_partkey", "1L as l_suppkey", "1 as l_linenumber", "1e0 as l_quantity",
                                 "1e0 as l_extendedprice", "0e0 as l_discount", "0e0 as l_tax", "'N' as l_returnflag", "'O' as l_linestatus",
                                 "timestamp'1996-01-01' as l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    both = j3_positional_attach(spark, str(tmp_path))
    assert "SortMergeJoin [__position" in both._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.l_orderkey, r.defect_prob) for r in both.collect()) == [(i, 0.48) for i in range(3000)]


def test_positions_and_positional_attach(spark):
    df = spark.range(0, 1000, 1, 7).where("id % 3 <> 0 or id > 500").select((-F.col("id")).alias("v"))
    got = [(r.v, r.position) for r in with_positions(df).orderBy("position").collect()]
    assert got == [(r.v, i) for i, r in enumerate(df.collect())]
    other = spark.range(0, 300, 1, 3).select((F.col("id") * 2).alias("v"), F.lit("x").alias("w"))
    both = attach_by_position(df, other)
    assert both.columns == ["v", "v_right", "w"]
    assert sorted(map(tuple, both.select("v", "v_right").collect())) == sorted(zip([v for v, _ in got], range(0, 600, 2)))
    assert attach_by_position(df.limit(0), other).count() == 0
    hot = spark.range(0, 5000, 1, 1).union(spark.range(0, 3, 1, 3))  # nearly all rows in one partition
    assert [r.position for r in with_positions(hot).orderBy("position").collect()] == list(range(5003))


def brute_metrics(part):
    y, p, hat = (part[c].to_numpy() for c in ("y", "p", "yhat"))
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    steps = [((p >= t) & (y == 1)).sum() / (p >= t).sum() * ((p == t) & (y == 1)).sum() / (y == 1).sum() for t in set(p)]
    tp, fp, fn = ((y == 1) & (hat == 1)).sum(), ((y == 0) & (hat == 1)).sum(), ((y == 1) & (hat == 0)).sum()
    return {"n": len(y), "accuracy": (y == hat).mean(), "precision": tp / (tp + fp), "recall": tp / (tp + fn),
            "f1": 2 * tp / (2 * tp + fp + fn), "roc_auc": auc, "average_precision": sum(steps)}


def test_metrics_by_group(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"m": rng.choice(["a", "b"], 300), "f": rng.integers(0, 2, 300), "p": rng.integers(0, 12, 300) / 11.0})
    pdf["y"] = (rng.random(300) < 0.2 + 0.6 * pdf["p"]).astype(int)
    pdf["yhat"] = (pdf["p"] >= 0.5).astype(int)
    got = {(r.m, r.f): r.asDict() for r in TR.metrics_by(spark.createDataFrame(pdf), ["m", "f"]).collect()}
    want = {k: brute_metrics(g) for k, g in pdf.groupby(["m", "f"])}
    assert set(got) == set(want)
    for k in want:
        assert all(got[k][name] == pytest.approx(v) for name, v in want[k].items())


def test_permutation_importance(spark, labelled):
    frame = TR.training_frame(labelled, ["a", "b", "c"], "defect", ["id"])
    model = MD.fit_classifier(frame.where("split = 'train'"), ["a", "b", "c"], small(480)["random_forest"])
    test = frame.where("split = 'test'")
    mixed = TR.shuffled_values(test.select("id", "a", "b", "c"), ["id", "a"], 3).toPandas()
    ids = sorted(r.id for r in test.collect())
    orders = []
    for r, part in mixed.groupby("repeat"):
        assert sorted(part["id"]) == ids and sorted(d["id"] for d in part["donor"]) == ids  # a permutation
        assert all(len(part) > 50 and d["a"] == dict(zip(part["id"], part["a"]))[d["id"]] for d in part["donor"])
        orders.append(tuple(d["id"] for d in part.sort_values("id")["donor"]))
    assert len(set(orders)) == 3
    got = {r.feature: (r.importance, r.deviation) for r in TR.permutation_importance(model, test, ["a", "b", "c"]).collect()}
    # brute force: the same shuffles, one column replaced at a time
    base = model.transform(test).select((F.col("prediction") == F.col("defect")).cast("int").alias("ok")).toPandas()["ok"].mean()
    every = TR.shuffled_values(test.select("a", "b", "c", F.col("defect").cast("int").alias("__y")), ["a", "b", "c"], 5).toPandas()
    for name in "abc":
        losses = []
        for _, part in every.groupby("repeat"):
            x = part[["a", "b", "c", "__y"]].copy()
            x[name] = [d[name] for d in part["donor"]]
            out = model.transform(spark.createDataFrame(x)).select((F.col("prediction") == F.col("__y")).cast("int").alias("ok")).toPandas()
            losses.append(base - out["ok"].mean())
        assert got[name] == (pytest.approx(np.mean(losses)), pytest.approx(np.std(losses)))
    assert got["a"][0] > 0.2 > abs(got["b"][0]) and got["c"] == (0.0, 0.0)


def test_importance_methods(spark, labelled):
    frame = TR.training_frame(labelled, ["a", "b"], "defect", ["id"])
    fitted = {n: MD.fit_classifier(frame, ["a", "b"], e) for n, e in small(600).items()}
    assert {r.method for r in TR.importance_frame(fitted["random_forest"], ["a", "b"]).collect()} == {"importances"}
    assert {r.method for r in TR.importance_frame(fitted["logistic_regression"], ["a", "b"]).collect()} == {"coefficients"}
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import MinMaxScaler
    from pyspark.ml import Pipeline
    plain = Pipeline(stages=[MD.assembler(["a", "b"]), MinMaxScaler(inputCol="features_raw", outputCol="features"),
                             NaiveBayes(labelCol="defect", modelType="gaussian")]).fit(frame)
    found = {r.feature: r for r in TR.importance_frame(plain, ["a", "b"], frame).collect()}
    assert {r.method for r in found.values()} == {"permutation"} and found["a"].importance > found["b"].importance
    assert {(r.importance, r.method) for r in TR.importance_frame(plain, ["a", "b"]).collect()} == {(0.0, "unavailable")}


def test_train_select_save_and_reuse(spark, labelled, tmp_path):
    path = str(tmp_path / "classifier")
    assert TR.probability_scorer(spark, path) is None
    board = TR.train_and_save(spark, labelled, ["a", "b", "c"], ["id"], path, small, folds=3).orderBy(F.desc("test_roc_auc")).collect()
    assert [r.selected for r in board].count(True) == 1 and board[0].selected and board[0].test_roc_auc > 0.9
    assert all(0 <= r[c] <= 1 for r in board for c in r.asDict() if c.startswith(("test_", "cv_")))
    assert all(r.cv_roc_auc_std > 0 for r in board)
    folder, name = IO.latest_version(spark, path)
    assert name == board[0].model
    saved = PipelineModel.load(f"{folder}/model")
    want = {r.id: r.p for r in saved.transform(labelled).select("id", F.element_at(
        __import__("pyspark.ml.functions", fromlist=["x"]).vector_to_array("probability"), 2).alias("p")).collect()}
    scorer = TR.probability_scorer(spark, path)
    # columns of the upload with the model's own names stay, text numbers are read, extra columns are carried
    upload = labelled.select("id", F.col("a").cast("string").alias("a"), "b", "c", F.lit("mine").alias("features"), F.lit(7).alias("prediction"))
    got = scorer.apply(upload).collect()
    assert {r.id: pytest.approx(r.defect_prob) for r in got} == want
    assert {(r.features, r.prediction) for r in got} == {("mine", 7)} and "probability" not in got[0].asDict()
    # a missing feature takes the training median; without one it fails
    assert scorer.apply(labelled.drop("c")).count() == 600
    from meltlens.operators.upload import SchemaMismatch
    scorer.fill.pop("c")
    with pytest.raises(SchemaMismatch):
        scorer.apply(labelled.drop("c"))
    # a version that was not committed is not seen
    saved.write().save(IO.new_version(path) + "/model")
    assert IO.latest_version(spark, path) == (folder, name)


def test_fits_of_large_tables_run_one_by_one(monkeypatch):
    import threading
    import time
    running, most, lock = [], [], threading.Lock()

    def task():
        with lock:
            running.append(1)
            most.append(len(running))
        time.sleep(0.05)
        with lock:
            running.pop()
        return 1

    monkeypatch.setattr(TR, "PARALLEL_ROWS", 100)
    for rows, limit in ((1000, 1), (50, 2), (1, 8)):
        most.clear()
        assert TR.side_by_side([task] * 10, rows) == [1] * 10 and max(most) == limit


def test_fit_takes_no_more_partitions_than_cores(spark, labelled):
    from pyspark.ml import Pipeline
    seen = []
    real = Pipeline.fit

    def fit(self, data, *a):
        seen.append(data.rdd.getNumPartitions())
        return real(self, data, *a)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(Pipeline, "fit", fit)
        MD.fit_classifier(MD.with_class_weights(labelled.repartition(50)), ["a", "b"], small(480)["logistic_regression"])
    assert max(seen) <= spark.sparkContext.defaultParallelism


def test_out_of_fold_and_report(spark, labelled):
    frame = TR.training_frame(labelled, ["a", "b"], "defect", ["id"], folds=3)
    assert {(r.split, r.n) for r in frame.groupBy("split").agg(F.count("*").alias("n")).collect()} == {("test", 120), ("train", 480)}
    oof = TR.out_of_fold(frame, ["a", "b"], small(480)["logistic_regression"])
    assert oof.count() == 600 and {r.fold for r in oof.select("fold").distinct().collect()} == {0, 1, 2}
    report = {(r.section, r.item, r.metric): r.value for r in TR.validation_report(oof, oof.select("y", "yhat")).collect()}
    folds = TR.metrics_by(oof, ["fold"]).toPandas()
    for m in TR.METRICS:
        assert report["cross_validation", m, "mean"] == pytest.approx(folds[m].mean())
        assert report["cross_validation", m, "std"] == pytest.approx(folds[m].std(ddof=0))
    whole = EV.classification_report(oof.select("y", "yhat")).toPandas().set_index("label")
    assert report["classification_report", "1", "recall"] == pytest.approx(whole.loc["1", "recall"])
    assert report["classification_report", "accuracy", "support"] == 600


def blobs(spark, k, n, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.permutation(k)[:, None] * 6.0 + rng.normal(size=(k, 2))
    x = np.concatenate([centres[i] + spread * rng.normal(size=(n // k, 2)) for i in range(k)])
    rows = [(i, float(a), float(b), int(i % 2)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, tapping_temp double, s_ double, defect int").repartition(4)


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b))
    return out


def test_sampled_silhouette(spark):
    df = blobs(spark, 3, 900, 5, 2.0).withColumn("v", array_to_vector(F.array("tapping_temp", "s_")))
    df = df.withColumns({"l": (F.col("id") % 4).cast("int"), "one": F.lit(0), "m": F.when(F.col("id") == 7, 9).otherwise((F.col("id") / 300).cast("int"))}).cache()
    pdf = df.orderBy("id").toPandas()
    x = pdf[["tapping_temp", "s_"]].to_numpy()
    whole = CL.sampled_silhouettes(df, "v", ["l", "one", "m"], "id", 2000)
    assert whole["l"] == pytest.approx(np.mean(brute_silhouette(x, pdf["l"].to_numpy())))
    assert whole["m"] == pytest.approx(np.mean(brute_silhouette(x, pdf["m"].to_numpy())))
    assert whole["one"] is None
    picked = [r.id for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("h")).orderBy("h").limit(100).collect()]
    some = CL.sampled_silhouettes(df, "v", ["l"], "id", 100)["l"]
    assert some == pytest.approx(np.mean(np.array(brute_silhouette(x, pdf["l"].to_numpy()))[picked]))


def test_kmeans_runs_share_passes(spark, monkeypatch):
    """All runs against Lloyd's steps in numpy; 21 runs take no more passes than one run's steps and the start."""
    df = blobs(spark, 4, 400, 9, 1.5).unionByName(blobs(spark, 4, 400, 9, 1.5).where("id < 40").withColumn("id", F.col("id") + 1000))
    df = df.withColumn("v", array_to_vector(F.array("tapping_temp", "s_"))).cache()
    x = df.select("tapping_temp", "s_").toPandas().to_numpy()
    passes, assigned = [], CL._assigned
    monkeypatch.setattr(CL, "_assigned", lambda *a: passes.append(1) or assigned(*a))
    runs = [(k, s) for k in (2, 3, 4) for s in (1, 2, 3)]
    for (k, _s), (centres, cost) in zip(runs, CL.fit_runs(df, "id", runs, "v")):
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        assert centres.shape == (k, 2) and cost == pytest.approx(d.min(axis=1).sum())
        means = np.array([x[d.argmin(axis=1) == c].mean(axis=0) for c in range(k)])
        assert np.allclose(means, centres, atol=1e-3)  # a fixed point of the whole table
    assert len(passes) <= 52
    same = CL._assigned(CL.point_blocks(df, "id", "v"), [np.array([[0.0, 0.0], [0.0, 0.0]])])[0]
    assert same[0].tolist() == [len(x), 0] and same[2] == pytest.approx((x ** 2).sum())  # ties count once
    model = CL.centres_model(spark, np.array([[0.0, 1.0], [5.0, 5.0], [9.0, 2.0]]), "v")
    assert sorted(map(list, model.clusterCenters())) == [[0.0, 1.0], [5.0, 5.0], [9.0, 2.0]]


def test_clustering_job_chooses_k(spark, tmp_path):
    chosen = {}
    for k in (3, 5):
        path = str(tmp_path / f"clusters{k}")
        out, found = CL.cluster_job(blobs(spark, k, 300, k), ["tapping_temp", "s_"], path, restarts=4, final_restarts=4)
        chosen[k] = next(n for n, *_, yes in found if yes)
        rows = out.toPandas()
        assert rows["cluster"].nunique() == chosen[k] and len(rows) == 300 and rows["id"].is_unique
        assert {"dbscan_cluster", "pca_pc1", "pca_pc2", "cluster"} <= set(rows)
        profile = CL.cluster_profile(out, ["tapping_temp", "s_"]).toPandas()
        assert profile["batch_count"].sum() == 300 and {"tapping_temp", "s_", "defect_rate", "dbscan_noise"} <= set(profile)
        means = rows.groupby("cluster")["s_"].mean().round(4)
        assert {r.cluster: r.s_ for r in profile.itertuples()} == pytest.approx(means.to_dict())
        again = CL.cluster_scorer(spark, path).apply(blobs(spark, k, 300, k)).toPandas().set_index("id").sort_index()
        first = rows.set_index("id").sort_index()
        assert (again["cluster"] == first["cluster"]).all() and np.allclose(again["pca_pc1"], first["pca_pc1"])
    assert chosen == {3: 3, 5: 5}


def test_frames_are_committed_together(spark, tmp_path):
    base = str(tmp_path / "report")
    assert IO.read_frames(spark, base) == {}
    IO.write_frames({"a": spark.range(3), "b": spark.range(5)}, base)
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        IO.write_frames({"a": spark.range(9), "b": bad}, base)
    assert {n: f.count() for n, f in IO.read_frames(spark, base).items()} == {"a": 3, "b": 5}
