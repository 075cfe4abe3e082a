"""Rule engine and decision layer: smoke row, boundary rows, properties."""

from pyspark.sql import functions as F

from meltlens.operators import decisions as D
from meltlens.operators import rules as R


def _row(spark, **vals):
    cols = ["s_", "mn_", "feat_ce_calculated", "mg_recovery_", "pouring_temp", "feat_temp_loss",
            "feat_shrinkage_risk_index", "feat_gas_risk_index", "defect_prob", "anomaly_score"]
    schema = ", ".join(f"{c} double" for c in cols) + ", cluster int"
    return spark.createDataFrame([tuple(vals.get(c) for c in cols) + (vals.get("cluster", -1),)], schema)


def test_reference_smoke_row_is_critical_stop(spark):
    df = _row(spark, s_=0.022, mn_=0.04, feat_ce_calculated=4.17, mg_recovery_=0.32, pouring_temp=1295.0,
              feat_temp_loss=95.0, feat_shrinkage_risk_index=2.9, feat_gas_risk_index=1.8,
              defect_prob=0.78, anomaly_score=0.82, cluster=2)
    r = R.interpret(df).first()
    assert (r["risk_level"], r["recommendation"]) == ("CRITICAL", "STOP")
    assert r["warnings"][0].startswith("HIGH: Sulfur = 0.0220%")
    assert any("Mn/S ratio = 1.8" in w for w in r["warnings"])


def test_all_null_row_is_low_proceed(spark):
    r = R.interpret(_row(spark)).first()
    assert (r["risk_level"], r["recommendation"]) == ("LOW", "PROCEED")
    assert r["warnings"] == []


def test_thresholds_are_strict_and_left_closed(spark):
    at = R.interpret(_row(spark, s_=0.015, defect_prob=0.5)).first()
    assert at["risk_level"] == "HIGH" and at["recommendation"] == "HOLD"  # prob >= .5 fires, s = .015 does not
    above = R.interpret(_row(spark, s_=0.0151)).first()
    assert above["recommendation"] == "HOLD"


def test_percent_scaled_probability_is_rescaled(spark):
    df = _row(spark, defect_prob=78.0, cluster=0).withColumn("defect", F.lit(0))
    d = D.unified_decisions(df).first()
    assert d["recommendation"] == "STOP" and d["final_risk_score"] == 78.0


def test_unknown_cluster_has_zero_rate(spark):
    df = _row(spark, defect_prob=0.1, cluster=9).withColumn("defect", F.lit(0))
    stats = spark.createDataFrame([(1, 0.9, 10, 0.0, True)],
                                  "cluster int, defect_rate double, batch_count long, avg_anomaly double, risky boolean")
    d = D.unified_decisions(df, stats=stats).first()
    assert d["risk_level"] == "LOW" and d["risk_factors"] == ""


def test_report_matches_decision_property(spark):
    import __spark_entry__ as E  # noqa: F401
    from meltlens.catalog.core import featured
    from meltlens.sources.fixtures import heats
    e = D.enrich(featured(spark, "/root/testdata/sf0.001"),
                 stats=D.cluster_stats(heats(spark, "/root/testdata/sf0.001")), row_key=F.col("l_orderkey"))
    assert e.agg(F.count_if(~D.summary_matches_decision(e))).first()[0] == 0
    # D9 is idempotent: a fresh table is not stale
    assert D.needs_refresh(e) is False


def test_stale_report_is_detected_and_refreshed(spark):
    df = _row(spark, s_=0.03, defect_prob=0.2, cluster=0).withColumn("defect", F.lit(1))
    e = D.enrich(df)
    tampered = e.withColumn("recommendation", F.lit("PROCEED"))
    assert D.needs_refresh(tampered) is True
    fixed = D.ensure_decisions(tampered).first()
    assert fixed["recommendation"] == "STOP" and "Recommendation: STOP" in fixed["qa_summary"]
