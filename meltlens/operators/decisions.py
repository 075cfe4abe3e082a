"""Unified decision layer.

One decision per batch: signals (classifier probability, anomaly score,
cluster history) and the rule engine are combined worst-of.  The whole layer
is one aggregate (cluster statistics, tiny and size-checked before it is
broadcast) plus one projection over the fact table -- no per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import compact_array, clamp01_scalar, flag, label_of, rank_of, sentinel_to_numeric
from ..functions.text import fmt
from ..plans.lookup import attach, own_stage
from .rules import REC_BY_SEVERITY, build_rules, escalate

TH = config.DECISION_THRESH
FINAL_DECISION_COLUMNS = ["risk_level", "recommendation", "final_risk_score", "risk_confidence",
                          "risk_factors", "qa_summary"]


def _numeric(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] == "string":
        return sentinel_to_numeric(F.col(name))
    return F.col(name).cast("double")


def cluster_id(name: str) -> Column:
    """Cluster as an int; text such as '2.0' is read as a number, anything else is -1 (as NULL is)."""
    return F.coalesce(F.col(name).try_cast("double").try_cast("int"), F.lit(-1))


def cluster_stats(df: DataFrame, label_col: str = "defect", prob_col: str = "defect_prob",
                  anomaly_col: str = "anomaly_score", cluster_col: str = "cluster") -> DataFrame:
    """Per cluster ``defect_rate`` (label, else probability, else 0),
    ``batch_count``, ``risky`` (rate >= hold rate) and ``avg_anomaly``.

    Partial aggregation happens map-side, so a cluster holding a third of all
    rows costs no more than any other.
    """
    cols = set(df.columns)
    if label_col in cols:
        rate_src = F.coalesce(_numeric(df, label_col), F.lit(0.0))
    elif prob_col in cols:
        rate_src = F.coalesce(_numeric(df, prob_col), F.lit(0.0))
    else:
        rate_src = F.lit(0.0)
    anom = F.coalesce(_numeric(df, anomaly_col), F.lit(0.0)) if anomaly_col in cols else F.lit(0.0)
    return (
        df.where(F.col(cluster_col).try_cast("double").try_cast("int").isNotNull())
        .groupBy(cluster_id(cluster_col).alias("cluster"))
        .agg(
            F.avg(rate_src).alias("defect_rate"),
            F.count(F.lit(1)).alias("batch_count"),
            F.avg(anom).alias("avg_anomaly"),
        )
        .withColumn("risky", F.col("defect_rate") >= TH["cluster_hold_rate"])
    )


def attach_cluster_stats(df: DataFrame, stats: DataFrame | None = None, cluster_col: str = "cluster") -> DataFrame:
    """Per-row cluster statistics; unknown cluster -> rate 0, not risky."""
    stats = stats if stats is not None else cluster_stats(df, cluster_col=cluster_col)
    s = stats.select(
        F.col("cluster").alias("__cl"),
        F.col("defect_rate").alias("cluster_defect_rate"),
        F.col("risky").alias("cluster_risky"),
    )
    key = cluster_id(cluster_col) if cluster_col in df.columns else F.lit(-1)
    joined = attach(df.withColumn("__cl", key), s, on="__cl", how="left")
    return joined.drop("__cl").withColumns({
        "cluster_defect_rate": F.coalesce(F.col("cluster_defect_rate"), F.lit(0.0)),
        "cluster_risky": F.coalesce(F.col("cluster_risky"), F.lit(False)),
    })


def _signal(df: DataFrame, name: str) -> Column:
    return clamp01_scalar(_numeric(df, name)) if name in df.columns else F.lit(0.0)


def decision_stages(df: DataFrame, th: dict | None = None, rule_th: dict | None = None) -> DataFrame:
    """D1-D5 over a frame that already carries ``cluster_defect_rate`` /
    ``cluster_risky`` (see :func:`attach_cluster_stats`).

    Evaluated in small projection stages so that no large sub-expression is
    referenced (and therefore copied) more than once.
    """
    t = dict(TH, **(th or {}))
    s1 = df.withColumns({
        "__p": _signal(df, "defect_prob"),
        "__a": _signal(df, "anomaly_score"),
        "__cl": cluster_id("cluster") if "cluster" in df.columns else F.lit(-1),
    })
    p, a, cl = F.col("__p"), F.col("__a"), F.col("__cl")
    rate, risky = F.col("cluster_defect_rate"), F.col("cluster_risky")
    rule_risk, rule_rec, _ = _rule_ranks(s1, p, a, rule_th)
    s2 = s1.withColumns({
        "__p_lvl": F.when(p >= t["defect_stop"], 3).when(p >= t["defect_hold"], 2)
        .when(p >= t["defect_monitor"], 1).otherwise(0),
        "__a_lvl": F.when(a >= t["anomaly_stop"], 3).when(a >= t["anomaly_hold"], 2)
        .when(a >= t["anomaly_monitor"], 1).otherwise(0),
        "__c_lvl": F.when(rate >= t["cluster_stop_rate"], 3).when(risky, 2).otherwise(0),
        "__rule_risk": rule_risk,
        "__rule_rec": rule_rec,
        "__factors": compact_array((
            F.when(p >= t["defect_stop"], fmt("Defect probability %.1f%% (critical)", p * 100.0))
            .when(p >= t["defect_hold"], fmt("Defect probability %.1f%% (high)", p * 100.0))
            .when(p >= t["defect_monitor"], fmt("Defect probability %.1f%% (elevated)", p * 100.0)),
            F.when(a >= t["anomaly_stop"], fmt("Anomaly score %.2f (critical pattern)", a))
            .when(a >= t["anomaly_hold"], fmt("Anomaly score %.2f (unusual process)", a))
            .when(a >= t["anomaly_monitor"], fmt("Anomaly score %.2f (monitor)", a)),
            F.when(rate >= t["cluster_stop_rate"],
                   fmt("Cluster %d historical defect rate %.1f%%", cl, rate * 100.0))
            .when(risky, fmt("Cluster %d elevated historical risk (%.1f%%)", cl, rate * 100.0)),
        )),
    })
    lv = [F.col("__p_lvl"), F.col("__a_lvl"), F.col("__c_lvl")]
    s3 = s2.withColumns({
        "__risk_rank": F.greatest(*lv, F.col("__rule_risk")),
        "__rec0": F.greatest(*lv, F.col("__rule_rec")),
    })
    risk_rank, rec0 = F.col("__risk_rank"), F.col("__rec0")
    # D2 consistency overrides (only a PROCEED/MONITOR under CRITICAL can change)
    rec = (F.when((rec0 == 0) & ((risk_rank == 3) | (a >= t["anomaly_stop"])), 3)
           .when((rec0 == 0) & (p >= t["defect_hold"]), 2)
           .when((rec0 == 1) & (risk_rank == 3), 2)
           .otherwise(rec0))
    n_high = (flag(p >= t["defect_monitor"]) + flag(a >= t["anomaly_monitor"])
              + flag(rate >= t["cluster_hold_rate"] * 0.5))
    s4 = s3.withColumns({"__rec": rec, "__n_high": n_high})
    out = s4.withColumns({
        "risk_level": label_of(risk_rank, config.RISK_ORDER),
        "recommendation": label_of(F.col("__rec"), REC_BY_SEVERITY),
        "final_risk_score": F.round(F.greatest(p, a, rate) * 100.0, 1),  # D3
        "risk_confidence": F.round(F.least(F.lit(0.95), 0.45 + 0.18 * F.col("__n_high")
                                           + 0.12 * F.size("__factors")), 2),  # D4
        "risk_factors": F.concat_ws("; ", F.col("__factors")),  # D5
    })
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def _rule_ranks(df: DataFrame, p: Column, a: Column, rule_th: dict | None):
    o = build_rules(df, p, a, rule_th)
    return escalate(o.risk), escalate(o.rec), o


def unified_decisions(df: DataFrame, stats: DataFrame | None = None, th: dict | None = None,
                      rule_th: dict | None = None, keep_stats: bool = False) -> DataFrame:
    """Cluster statistics -> lookup -> one decision projection per row.

    ``stats`` freezes the cluster history (training statistics); by default it
    is computed from ``df`` itself, which is what the reference does (T10).
    """
    with_stats = attach_cluster_stats(df, stats)
    out = decision_stages(with_stats, th, rule_th)
    if not keep_stats:
        out = out.drop("cluster_defect_rate", "cluster_risky")
    return out


# ---------------------------------------------------------------------------
# D7 report text, D8 consistency, D9 refresh guard, D10 reason lines
# ---------------------------------------------------------------------------
_RULE_LINE = "----------------------------------------"


def _bullets(arr: Column) -> Column:
    """``- item`` lines (or ``- None triggered.``) without a per-element lambda:
    higher-order functions are evaluated outside generated code."""
    joined = F.concat(F.lit("- "), F.array_join(arr, "\n- "))
    return F.when(F.size(arr) > 0, joined).otherwise(F.lit("- None triggered."))


def _split_factors(c: Column) -> Column:
    """``'a; b;; c'`` -> ``['a', 'b', 'c']`` (trimmed, empties dropped, legacy word cleaned)."""
    cleaned = F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit(config.LEGACY_STOP_WORD), F.lit("STOP"))
    parts = F.split(F.regexp_replace(F.trim(cleaned), r"\s*;\s*", ";"), ";")
    return F.array_remove(parts, "")


def batch_id(df: DataFrame, row_key: Column | None = None) -> Column:
    """First non-blank identifier column, else ``Row <key>``."""
    cands = [c for c in ("heat", "heat_no", "heat_number", "batch", "batch_id", "casting", "casting_no",
                         "serial", "aa") if c in df.columns]
    parts = []
    for c in cands:
        s = F.trim(F.col(c).cast("string"))
        parts.append(F.when((F.length(s) > 0) & (F.lower(s) != "nan"), F.col(c).cast("string")))
    fallback = F.concat(F.lit("Row "), row_key.cast("string")) if row_key is not None else F.lit("N/A")
    return F.coalesce(*parts, fallback) if parts else fallback


def with_qa_report(df: DataFrame, row_key: Column | None = None, rule_th: dict | None = None,
                   name: str = "qa_summary") -> DataFrame:
    """The full multi-line report for each decided row (pure columns,
    evaluated in stages so the rule texts are built once per row)."""
    s1 = own_stage(df).withColumns({
        "__p": _signal(df, "defect_prob"),
        "__a": _signal(df, "anomaly_score"),
        "__cl": cluster_id("cluster") if "cluster" in df.columns else F.lit(-1),
        "__conf": clamp01_scalar(F.col("risk_confidence")) if "risk_confidence" in df.columns else F.lit(0.5),
        "__bid": batch_id(df, row_key),
    })
    p, a, cl = F.col("__p"), F.col("__a"), F.col("__cl")
    o = build_rules(s1, p, a, rule_th)
    given = _split_factors(F.col("risk_factors")) if "risk_factors" in df.columns \
        else F.array().cast("array<string>")
    derived = compact_array((
        F.when(p != 0, fmt("Defect probability signal %.1f%%", p * 100.0)),
        F.when(a != 0, fmt("Anomaly score signal %.2f", a)),
        F.when(cl >= 0, fmt("Cluster %d process grouping", cl)),
    ))
    s2 = own_stage(s1.withColumns({
        "__warn": compact_array(o.warnings),
        "__causes": compact_array(o.causes),
        "__acts": compact_array(o.actions),
        "__given": given,
        "__derived": derived,
    }))
    base = F.when(F.size("__given") > 0, F.col("__given")).otherwise(F.col("__derived"))
    # generated texts never contain the legacy word; given factors were cleaned on split
    s3 = s2.withColumn("__factors", F.array_distinct(F.concat(base, F.col("__warn"))))
    risk = F.coalesce(F.col("risk_level"), F.lit("LOW"))
    rec = F.col("recommendation")
    report = F.concat_ws(
        "\n",
        # The report's headings and labels.
        F.lit(_RULE_LINE), F.lit("INDUSTRIAL QA REPORT"), F.lit(_RULE_LINE), F.lit(""),
        F.concat(F.lit("Batch ID: "), F.col("__bid")),
        F.concat(F.lit("Risk Level: "), risk),
        F.concat(F.lit("Recommendation: "), rec),
        fmt("Defect Probability: %.1f%%", p * 100.0),
        fmt("Confidence: %.0f%%", F.col("__conf") * 100.0),
        fmt("Anomaly Score: %.2f", a),
        fmt("Cluster: %d", cl),
        F.lit(""), F.lit("WARNINGS"), _bullets(F.col("__warn")),
        F.lit(""), F.lit("PROBABLE CAUSES"), _bullets(F.col("__causes")),
        F.lit(""), F.lit("ENGINEERING RECOMMENDATIONS"), _bullets(F.col("__acts")),
        F.lit(""), F.lit("RISK FACTORS"), _bullets(F.col("__factors")),
        F.lit(""), F.lit("FINAL RECOMMENDATION"), rec,
        F.lit(""), F.lit(_RULE_LINE),
    )
    out = s3.withColumn(name, report)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def enrich(df: DataFrame, stats: DataFrame | None = None, row_key: Column | None = None) -> DataFrame:
    """D6 + D7: decisions plus the report text."""
    return with_qa_report(unified_decisions(df, stats), row_key)


def summary_matches_decision(df: DataFrame) -> Column:
    """D8 (row predicate): the report text agrees with the decision fields."""
    p, a = _signal(df, "defect_prob"), _signal(df, "anomaly_score")
    cl = cluster_id("cluster") if "cluster" in df.columns else F.lit(-1)
    risk = normalize_risk(F.col("risk_level"))
    rec = normalize_recommendation(F.col("recommendation"))
    summ = F.coalesce(F.col("qa_summary").cast("string"), F.lit(""))
    expected = [
        # The same headings and labels.
        F.lit("INDUSTRIAL QA REPORT"),
        F.concat(F.lit("Risk Level: "), risk),
        F.concat(F.lit("Recommendation: "), rec),
        fmt("Defect Probability: %.1f%%", p * 100.0),
        fmt("Anomaly Score: %.2f", a),
        fmt("Cluster: %d", cl),
        F.lit("FINAL RECOMMENDATION"),
    ]
    ok = ~summ.contains(config.LEGACY_STOP_WORD) & (rec == F.coalesce(F.col("recommendation"), F.lit("")))
    for e in expected:
        ok = ok & summ.contains(e)
    return F.coalesce(ok, F.lit(False))


def needs_refresh(df: DataFrame) -> bool:
    """D8 (table): missing or stale decision fields -> True.  One bounded action."""
    cols = set(df.columns)
    signals = set(FINAL_DECISION_COLUMNS) | {"defect_prob", "anomaly_score", "cluster"}
    if not (signals & cols):
        return False
    if not set(FINAL_DECISION_COLUMNS) <= cols:
        return True
    stale = ~summary_matches_decision(df) | F.coalesce(
        F.col("recommendation").contains(config.LEGACY_STOP_WORD), F.lit(False))
    # an aggregate (not a filter): a filter would be pushed through the report
    # projection and inline the report expression once per `contains`
    return (df.agg(F.count_if(stale).alias("n")).first()["n"] or 0) > 0


def ensure_decisions(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Re-enrich when stale, else only normalise the recommendation vocabulary."""
    if needs_refresh(df):
        return enrich(df.drop(*[c for c in FINAL_DECISION_COLUMNS if c in df.columns]), stats)
    if "recommendation" in df.columns:
        return df.withColumn("recommendation", normalize_recommendation(F.col("recommendation")))
    return df


def reason_lines(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """One row per non-empty trimmed risk factor, with its position; without factors, the
    recommendation and the risk level as two lines."""
    named = lambda label, c: F.concat(F.lit(label), F.coalesce(F.col(c).cast("string"), F.lit("N/A")))
    fallback = F.array(named("Final recommendation: ", "recommendation"), named("Risk level: ", "risk_level"))
    factors = _split_factors(F.col("risk_factors"))
    blank = F.trim(F.coalesce(F.col("risk_factors").cast("string"), F.lit(""))) == ""
    return df.select(*key_cols, F.posexplode(F.when(blank, fallback).otherwise(factors)).alias("pos", "reason"))


# ---------------------------------------------------------------------------
# C19 / C20 vocabulary normalisation
# ---------------------------------------------------------------------------
def normalize_recommendation(c: Column) -> Column:
    r = F.upper(F.trim(F.coalesce(c.cast("string"), F.lit("PROCEED"))))
    r = F.when(r == "", F.lit("PROCEED")).otherwise(r)
    return F.when(r.isin("STOP", config.LEGACY_STOP_WORD), F.lit("STOP")).otherwise(r)


def normalize_risk(c: Column) -> Column:
    r = F.upper(F.trim(F.coalesce(c.cast("string"), F.lit("LOW"))))
    return F.when(r.isin(*config.RISK_ORDER), r).otherwise(F.lit("LOW"))


def risk_display_bucket(c: Column) -> Column:
    """C20: aliases -> HEALTHY, known levels kept, anything else -> LOW."""
    r = F.upper(F.trim(F.coalesce(c.cast("string"), F.lit("NAN"))))
    return (F.when(r.isin(*config.RISK_DISPLAY_HEALTHY_ALIASES), F.lit("HEALTHY"))
            .when(r.isin(*config.RISK_DISPLAY_ORDER), r).otherwise(F.lit("LOW")))


def risk_rank(c: Column) -> Column:
    return rank_of(c, config.RISK_ORDER, 0)
