"""Report frames, cleaning and validation reports, the feature contract, driver fallback and fold spread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meltlens.operators import analytics as AN
from meltlens.operators import reports as RP
from meltlens.operators import schema as H
from meltlens.operators import training as TR
from meltlens.sources import io as IO

DECIDED = "k long, defect int, cluster int, defect_prob double, anomaly_score double, risk_level string, recommendation string, " \
          "final_risk_score double, risk_confidence double, risk_factors string"


@pytest.fixture(scope="module")
def fleet(spark):
    rows = [(i, i % 2, i % 3, i / 100, (i * 7 % 100) / 100, ["LOW", "HIGH", "CRITICAL"][i % 3],
             ["PROCEED", "HOLD", "STOP"][i % 3], float(i), 0.5, "some factor") for i in range(100)]
    rows.append((None, None, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, DECIDED)


def items(df):
    return {r["item"]: r["value"] for r in df.collect()}


def test_summary_and_selected_batch(fleet):
    got = items(RP.fleet_summary(fleet, {"k": 5}))
    assert got == {"Total batches": "101", "Avg defect probability": "49.5%", "Critical batches": "33", "Recommendation PROCEED": "34",
                   "Recommendation MONITOR": "0", "Recommendation HOLD": "33", "Recommendation STOP": "33", "Selected batch": "5",
                   "Selected risk level": "CRITICAL", "Selected recommendation": "STOP"}
    assert "Selected batch" not in items(RP.fleet_summary(fleet, {"k": 1000}))
    assert items(RP.fleet_summary(fleet, {"k": None}))["Selected batch"] == "None"
    assert items(RP.fleet_summary(fleet.select("k").limit(0))) == {"Total batches": "0"}


def test_export_frames_are_whole_and_committed_together(spark, fleet):
    base = IO.scratch_path(spark, "frames")
    texts = fleet.withColumn("qa_summary", F.lit("text"))
    IO.write_frames({"first": texts, "count": lambda done: done["first"].groupBy().count()}, base)
    before = IO.read_frames(spark, base)
    assert before["count"].head()[0] == 101

    def fails(done):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        IO.write_frames({"first": texts.limit(1), "count": fails}, base)
    assert IO.read_frames(spark, base)["first"].count() == 101

    made = RP.export_frames(fleet.drop(*[c for c in fleet.columns if c.startswith(("ris", "rec", "fin"))]), ["k"], {"k": 5})
    IO.write_frames(made, base)
    got = IO.read_frames(spark, base)
    assert set(got) == {"processed", "fleet_summary", "risk_anomaly", "selected_batch", "top_anomalies"}
    assert got["processed"].count() == got["risk_anomaly"].count() == 101
    top = [r["anomaly_score"] for r in got["top_anomalies"].collect()]
    assert len(top) == 50 and min(top) == 0.5
    fields = {r["field"]: r["value"] for r in got["selected_batch"].collect()}
    assert fields["k"] == "5" and "INDUSTRIAL QA REPORT" in fields["qa_summary"]


def test_repeated_columns_go_before_the_export(fleet):
    twice = fleet.select("k", "defect_prob", "anomaly_score", "cluster", "cluster", F.lit(1).alias("k"))
    out = RP.export_frame(twice)
    assert out.columns.count("k") == out.columns.count("cluster") == 1
    assert out.where("k = 7").count() == 1


def test_report_sections(fleet):
    full = RP.full_report_sections(fleet, ["k"], {"k": 5})
    assert full["processed_sample"].count() == 40 and full["top_anomalies"].count() == 25
    assert "Risk Level: CRITICAL" in items(full["selected_batch"])["Selected batch"]
    lines = RP.executive_sections(fleet)
    assert items(lines["fleet_kpis"]) == {"Total batches": "101", "Defect rate": "50.0%", "Avg defect probability": "49.5%"}
    assert {r["risk_level"]: r["n"] for r in lines["risk_distribution"].collect()} == {"LOW": 34, "HIGH": 33, "CRITICAL": 33, None: 1}
    one = RP.batch_sections(fleet, {"k": 5})
    assert items(one["assessment"])["Anomaly"] == "0.35"
    assert one["parameters"].count() == len(fleet.columns)
    none = RP.batch_sections(fleet, {"k": 1000})
    assert all(df.count() == 0 for df in none.values())
    bare = RP.batch_sections(fleet.select("k"), {"k": 5})
    assert items(bare["assessment"])["Risk"] == "N/A"
    assert items(bare["engineering_narrative"]) == {"qa_summary": "No QA summary available."}
    assert items(RP.executive_sections(fleet.select("k"))["fleet_kpis"])["Defect rate"] == "N/A"


def test_model_sections(spark):
    preds = spark.createDataFrame([(0, 0.1, 0), (0, 0.6, 1), (1, 0.9, 1), (1, 0.4, 0), (1, 0.7, 1)], "y int, p double, yhat int")
    importance = spark.createDataFrame([("a", 1.0)], "feature string, importance double")
    got = RP.model_sections(preds, importance, "table", 3)
    assert items(got["evaluation_summary"]) == {"Dataset": "table", "Samples": "5", "Features": "3"}
    cells = {r["outcome"]: r["value"] for r in got["confusion_matrix"].collect()}
    assert cells == {"True Negative": 1, "False Positive": 1, "False Negative": 1, "True Positive": 2, "False Alarm Rate": 0.5,
                     "Missed Defect Rate": pytest.approx(1 / 3)}
    assert got["metrics"].count() > 0 and got["confidence"].count() > 0


def test_cleaning_report(spark):
    rows = [("1", "1300", "x1", "9", None, "5", str(i % 2)) for i in range(6)]  # three copies of two rows
    rows += [("2", "9999", "x2", None, None, "5", "1"), ("3", "-", "x3", None, None, "6", "0"), ("4", "1400", "x4", None, None, "7", None)]
    rows += [(None,) * 7] * 2
    raw = spark.createDataFrame(rows, "`C %` string, `Tapping Temp` string, `Casting SR` string, sparse string, empty string, mg string, Defected string")
    clean, trace, report = RP.cleaning_report(raw)
    got = {(r["section"], r["item"]): r["value"] for r in report.collect()}
    assert got["shape", "raw rows"] == "11" and got["shape", "raw columns"] == "7"
    assert got["rows removed", "empty"] == "2" and got["rows removed", "duplicate"] == "4" and got["rows removed", "missing target"] == "1"
    assert got["columns", "empty"] == "empty" and got["columns", "leakage"] == "mg" and got["columns", "traceability"] == "casting_sr"
    assert got["column mapping", "Tapping Temp"] == "tapping_temp"
    assert got["target", "0"] == "2" and got["target", "1"] == "2"
    assert got["missing before imputation", "tapping_temp"] == "1 (25.0%)"
    assert got["impossible values", "tapping_temp"] == "1"
    assert got["final", "rows"] == "4" == str(clean.count()) == str(trace.count())
    plain = RP.C.clean_table(raw)[0]
    assert sorted(map(str, plain.collect())) == sorted(map(str, clean.collect()))


def test_validation_report(spark, fleet):
    p = spark.createDataFrame([(i % 2, i % 3 == 0 and 1 or 0, (i * 37 % 60) / 60, int((i * 37 % 60) >= 30)) for i in range(60)],
                              "fold int, y int, p double, yhat int")
    comparison = spark.createDataFrame([("m1", 0.5, 0.25)], "model string, roc_auc double, f1 double")
    sil = spark.createDataFrame([(0.25,), (0.75,)], "silhouette double")
    names = spark.createDataFrame([(1, "hot"), (2, None)], "cluster int, interpretation string")
    got = {(r["section"], r["item"]): r["value"] for r in RP.validation_report(fleet, p, p, comparison, sil, names).collect()}
    by_fold = [r.asDict() for r in TR.metrics_by(p, ["fold"]).collect()]
    aucs = [r["roc_auc"] for r in by_fold]
    assert got["classification", "CV ROC-AUC"] == f"{np.mean(aucs):.4f} ± {np.std(aucs):.4f}"
    assert got["classification report", "Healthy support"] == "40"
    assert got["model comparison", "m1 f1"] == "0.2500"
    assert got["clustering", "Silhouette Score (PCA space)"] == "0.5000"
    assert got["clustering", "Cluster 0 batch_count"] == "34" and got["clustering", "Cluster 0 defect_rate"] == "0.5000"
    assert got["cluster interpretations", "Cluster 1"] == "hot" and got["cluster interpretations", "Cluster 2"] == ""
    assert got["anomaly", "Anomaly flag rate"] == "40.00%"
    assert got["anomaly", "Defect 1 anomaly 1"] == "20"
    assert got["kpi", "Total Batches"] == "101" and got["kpi", "Defective Batches"] == "50"
    assert ("kpi", "Avg Sulfur %") not in got
    empty = {r["section"] for r in RP.validation_report(spark.createDataFrame([(1,)], "x int")).collect()}
    assert empty == {"classification", "clustering", "anomaly", "kpi"}
    assert RP.validation_report(fleet.limit(0)).where("section = 'clustering'").count() == 0


@pytest.mark.parametrize("columns,kinds", [
    ("a double, b double, c double", set()),
    ("a double, b double", {("missing", "c")}),
    ("a double, b double, c double, d double", {("extra", "d")}),
    ("a double, c double, b double", {("order", "c"), ("order", "b")}),
    ("a double, b string, c double", {("dtype", "b")}),
    ("a double, a double, b double, c double", {("duplicate", "a")}),
])
def test_contract_of_columns(spark, columns, kinds):
    n = columns.count(",") + 1
    row = tuple("x" if "string" in part else 1.0 for part in columns.split(","))
    df = spark.createDataFrame([row], ", ".join(f"c{i} {p.split()[1]}" for i, p in enumerate(columns.split(",")))).toDF(
        *[p.split()[0] for p in columns.split(",")])
    assert len(df.columns) == n
    found = {(r["kind"], r["column"]) for r in H.schema_violations(df, ["a", "b", "c"]).collect()}
    assert found == kinds
    if kinds:
        with pytest.raises(ValueError, match=next(iter(kinds))[0]):
            H.require_schema(df, ["a", "b", "c"])
    else:
        assert H.require_schema(df, ["a", "b", "c"]) is df


def test_contract_of_values_and_versions(spark):
    df = spark.createDataFrame([(1.0, float("inf")), (None, float("-inf")), (float("nan"), 2.0)], "a double, b double")
    found = {(r["kind"], r["column"], r["n_rows"]) for r in H.schema_violations(df, ["a", "b"]).collect()}
    assert found == {("infinite", "b", 2), ("null", "a", 2)}
    fine = H.align_to_schema(df, ["a", "b"], {"a": 0.0, "b": 0.0})
    H.require_schema(fine, ["a", "b"], filled=["a"])
    with pytest.raises(ValueError, match="filled a"):
        H.require_schema(fine, ["a", "b"], filled=["a"], strict_missing=True)
    base = IO.scratch_path(spark, "contract")
    with pytest.raises(FileNotFoundError):
        IO.published_schema(spark, base)
    IO.publish_schema(spark, ["a"], base, "one")
    IO.publish_schema(spark, ["b", "a"], base, "two")
    assert IO.published_schema(spark, base) == ["b", "a"]


@pytest.mark.parametrize("labels,both", [((0, 1), True), ((1,), False), ((0,), False), ((None,), False)])
def test_driver_fallback(spark, labels, both):
    rng = np.random.default_rng(3)
    rows = [(labels[i % len(labels)], float(rng.normal()), float(rng.normal()), float(rng.random())) for i in range(80)]
    got = {r["parameter"]: r["impact"] for r in AN.defect_drivers(
        spark.createDataFrame(rows, "defect int, a double, b double, defect_prob double"), ["a", "b"]).collect()}
    for place, name in ((1, "a"), (2, "b")):
        x, p = np.array([r[place] for r in rows]), np.array([r[3] for r in rows])
        if both:
            y = np.array([r[0] for r in rows])
            want = abs(x[y == 1].mean() - x[y == 0].mean())
        else:
            want = abs(np.corrcoef(x, p)[0, 1])
        assert got[name] == pytest.approx(want)


def test_fold_spread(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 5), int(rng.random() < 0.4), float(rng.random())) for i in range(300)]
    df = spark.createDataFrame(rows, "fold int, y int, p double").withColumn("yhat", (F.col("p") >= 0.5).cast("int"))
    folds = [r.asDict() for r in TR.metrics_by(df, ["fold"]).collect()]
    for r in TR.fold_spread(df).collect():
        want = np.percentile([f[r["metric"]] for f in folds], [0, 25, 50, 75, 100])
        assert [r["min"], r["q1"], r["median"], r["q3"], r["max"]] == pytest.approx(list(want)) and r["n"] == 5


def test_duplicate_counts(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (None, None), (None, None), (None, None)], "x int, y string")
    got = {(r["x"], r["y"]): r["n_copies"] for r in RP.C.count_duplicate_rows(df).collect()}
    assert got == {(1, None): 2, (1, "a"): 1, (None, None): 3}


def test_safe_frame(spark):
    rows = [("10%", "x", 1, 1.0, "2", None), (" - ", "y", None, float("inf"), "bad", None), ("30", None, 4, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, i int, d double, cluster string, none double").toDF("a", "b", "i", "d", "cluster", "none")
    out = RP.C.safe_frame(df.select("*", F.lit("again").alias("b"), F.lit("5").alias("risk_level")))
    got = [r.asDict() for r in out.orderBy(F.col("b").asc_nulls_last()).collect()]
    assert out.columns.count("b") == 1 and dict(out.dtypes)["risk_level"] == "string"
    assert [r["a"] for r in got] == [10.0, 20.0, 30.0] and [r["i"] for r in got] == [1.0, 2.5, 4.0]
    assert [r["d"] for r in got] == [1.0, 1.0, 1.0] and [r["cluster"] for r in got] == [2, 0, 0]
    assert all(r["none"] == 0.0 == r["pca_pc1"] == r["defect_prob"] for r in got)
    assert RP.C.safe_frame(df.limit(0)).count() == 0


def test_row_filters(spark):
    rows = [(1, "1", 0.9, "HIGH"), (2, "0", 0.9, "LOW"), (3, None, 0.1, None), (4, "1", 0.2, "CRITICAL")]
    df = spark.createDataFrame(rows, "k int, defect string, defect_prob double, risk_level string")
    keys = lambda d: sorted(r["k"] for r in d.collect())
    assert keys(RP.C.healthy_rows(df)) == [2, 3]
    bad = df.where("defect = '1'")
    assert keys(RP.C.healthy_rows(bad)) == [4]
    assert keys(RP.C.healthy_rows(bad.where("k = 1"))) == [1]
    assert keys(RP.C.healthy_rows(df.select("k"))) == [1, 2, 3, 4]
    assert keys(RP.C.healthy_rows(df.limit(0))) == []
    assert keys(RP.C.high_risk_rows(df)) == [1, 4]
    assert keys(RP.C.rows_with(df, "risk_level", "LOW")) == [2]
    assert keys(RP.C.rows_with(df, "absent", "LOW")) == [1, 2, 3, 4]
    assert keys(RP.C.cluster_rows(df, 1)) == []


def test_missing_reason(spark):
    df = spark.createDataFrame([(1.0, "x")], "c_ double, si_ string")
    assert H.chemistry_columns(df) == ["c_"] == H.process_feature_columns(df)
    assert H.missing_reason(df, ["c_"]) is None
    assert H.missing_reason(df, ["c_", "b", "a"], "chart") == "No chart: missing columns b, a."
    assert H.missing_reason(df.limit(0), ["c_"], "chart") == "No chart: dataframe is empty."


def test_health_cards_and_leaderboard(spark):
    from meltlens.operators import evaluation as EV
    df = spark.createDataFrame([(0, 0.1, 0), (0, 0.6, 1), (1, 0.9, 1), (1, 0.4, 0), (1, 0.7, 1)], "y int, p double, yhat int")
    h = EV.health_scalars(df).head()
    assert (h["defect_share"], h["high_confidence_share"], h["n_low_confidence"]) == (0.6, 0.4, 2)
    assert (h["defects_caught"], h["decisions_protected"], h["false_alarm_reduction"]) == (2, 4, 0.5)
    assert h["quality_improvement"] == pytest.approx(2 / 3 * 2 / 3 * 100)
    perfect = EV.health_scalars(spark.createDataFrame([(0, 0.1, 0), (1, 0.9, 1)], "y int, p double, yhat int")).head()
    assert perfect["quality_improvement"] == 99.0
    empty = EV.health_scalars(df.limit(0)).head()
    assert empty["defects_caught"] == 0 and empty["decisions_protected"] == 1 and empty["false_alarm_rate"] is None
    cards = {r["metric"]: r["status"] for r in EV.metric_cards(df).collect()}
    assert cards["false_alarm_rate"] == "poor" and cards["accuracy"] == "poor"
    assert {r["status"] for r in EV.metric_cards(spark.createDataFrame([(0, 0.1, 0), (1, 0.9, 1)], "y int, p double, yhat int")).collect()} == {"good"}
    board = EV.leaderboard(spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", None), ("d", 0.4)], "model string, roc_auc double"))
    assert [(r["model"], r["rank"], r["selected"]) for r in board.orderBy("rank").collect()] == [
        ("a", 1, True), ("b", 2, False), ("d", 3, False), ("c", 4, False)]


def test_sample_template(spark):
    stats = spark.createDataFrame([(3.5, 1000.0, None)], "c_ double, tapping_temp double, gone double")
    row = IO.sample_template(stats, ["c_", "tapping_temp", "gone", "absent", "defect"], 1).head().asDict()
    assert row == {"c_": 3.5, "tapping_temp": 1435.0, "gone": 0.0, "absent": 0.0, "defect": 1}


def test_spread_deals_only_few_partitions(spark, tmp_path):
    from meltlens.plans.lookup import spread
    cores = spark.sparkContext.defaultParallelism
    path = IO.scratch_path(spark, "one-file")
    spark.range(0, 5000).select("id", F.lit("x").alias("other")).coalesce(1).write.parquet(path)
    few = spread(spark.read.parquet(path), ["id"])
    if cores > 1:
        assert few.rdd.getNumPartitions() == cores
        assert few.groupBy(F.spark_partition_id()).count().count() == cores
    assert few.agg(F.count_distinct("id")).head()[0] == 5000
    many = spark.range(0, 5000, 1, cores + 1)
    assert spread(many, ["id"]) is many
