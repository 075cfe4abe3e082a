"""Features (F*), rules (R*) and decisions (D*, A7, J1) over the heats fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clamp01_scalar
from ..operators import decisions as D
from ..operators import features as FE
from ..operators import rules as R
from ..plans.lookup import spread
from ..plans.registry import register
from ..sources.fixtures import HEAT_KEY, heats, with_fixtures
from .sqlparts import FEATURE_COLS, KEY, decided_sql, features_sql


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features but the Mg deviation, which needs a statistics job of its own."""
    return FE.engineer_features(heats(spark, sf_dir), mg_deviation=False)


def spread_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`featured` for the long row-local stages (rules, decisions, report texts)."""
    return FE.engineer_features(spread(heats(spark, sf_dir), HEAT_KEY), mg_deviation=False)


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    # cluster history needs only (cluster, defect, anomaly): aggregate the
    # pruned base scan, not the featured frame
    return D.unified_decisions(spread_features(spark, sf_dir), stats=D.cluster_stats(heats(spark, sf_dir)))


# ---------------------------------------------------------------------------
# minimum slice: decide every batch, count per (risk, recommendation)
# ---------------------------------------------------------------------------
@register("d11_decision_summary", decided_sql(
    "select risk_level, recommendation, count(*) as n_batches from final group by risk_level, recommendation"))
def d11_decision_summary(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("risk_level", "recommendation").agg(F.count(F.lit(1)).alias("n_batches"))


# ---------------------------------------------------------------------------
# F*: features
# ---------------------------------------------------------------------------
def _feature_query(inputs: list[str], outputs: list[str]):
    def q(spark, sf_dir):
        h = heats(spark, sf_dir).select(*HEAT_KEY, *inputs)
        return FE.engineer_features(h).select(*HEAT_KEY, *outputs)
    return q


def _feature_sql(outputs: list[str]) -> str:
    return features_sql(f"select {KEY}, {', '.join(outputs)} from feat")


_FEATURE_FAMILIES = {
    "f1_carbon_equivalent": (["c_", "si_", "p__"], ["feat_ce_calculated"]),
    "f2_ce_zone_flags": (["c_", "si_", "p__"], ["feat_ce_hypo_risk", "feat_ce_hyper_risk", "feat_ce_optimal"]),
    "f3_c_si_ratio": (["c_", "si_"], ["feat_c_si_ratio", "feat_c_si_risk"]),
    "f4_mn_s_ratio": (["mn_", "s_"], ["feat_mn_s_ratio", "feat_mn_s_risk"]),
    "f5_sulfur_risk": (["s_"], ["feat_sulfur_risk"]),
    "f6_mg_recovery": (["mg_recovery_"], ["feat_mg_recovery_risk", "feat_mg_recovery_severe", "feat_mg_recovery_dev"]),
    "f7_temperature_loss": (["tapping_temp", "pouring_temp"], ["feat_temp_loss", "feat_temp_loss_risk", "feat_temp_loss_low"]),
    "f8_pouring_stability": (["pouring_temp"], ["feat_pouring_stability", "feat_pouring_risk"]),
    "f9_oxidation_risk": (["al__", "pouring_temp"], ["feat_oxidation_risk"]),
    "f10_graphitization": (["si_", "cr_", "mn_"], ["feat_graphitization_index", "feat_white_iron_risk"]),
    "f11_shrinkage": (["c_", "si_", "p__", "pouring_temp"], ["feat_shrinkage_risk_index"]),
    "f12_gas_porosity": (["n__", "mg_", "crca"], ["feat_gas_risk_index"]),
    "f13_chemistry_stability": (["c_", "si_", "mn_", "mg_"], ["feat_chemistry_instability", "feat_chemistry_ok"]),
    "f14_fsm_efficiency": (["fsmaddition_mt", "s_"], ["feat_fsm_s_index", "feat_fsm_undertreat_risk"]),
    "f15_heel_ratio": (["heel", "tapped_wt_"], ["feat_heel_ratio", "feat_heel_risk"]),
}
for _name, (_ins, _outs) in _FEATURE_FAMILIES.items():
    register(_name, _feature_sql(_outs))(_feature_query(_ins, _outs))


@register("f0_safe_division", features_sql(
    f"select {KEY}, coalesce(c_ / nullif(tapped_wt_, 0e0), 0e0) as c_per_tapped, "
    "coalesce(heel / nullif(tapped_wt_, 0e0), -1e0) as heel_per_tapped from heats"))
def f0_safe_division(spark, sf_dir):
    from ..functions.scalar import safe_div
    h = heats(spark, sf_dir)
    return h.select(*HEAT_KEY, safe_div(F.col("c_"), F.col("tapped_wt_")).alias("c_per_tapped"),
                    safe_div(F.col("heel"), F.col("tapped_wt_"), -1.0).alias("heel_per_tapped"))


@register("f16_feature_table", _feature_sql(FEATURE_COLS))
def f16_feature_table(spark, sf_dir):
    return FE.engineer_features(heats(spark, sf_dir)).select(*HEAT_KEY, *FE.FEATURE_ORDER)


_ONLINE = ["feat_ce_calculated", "feat_ce_hypo_risk", "feat_ce_hyper_risk", "feat_c_si_ratio", "feat_mn_s_ratio", "feat_sulfur_risk",
           "feat_mg_recovery_risk", "feat_temp_loss", "feat_temp_loss_risk", "feat_shrinkage_risk_index", "feat_gas_risk_index",
           "feat_chemistry_instability"]


@register("f17_online_features", with_fixtures(
    f"""select {KEY}, mg as mg_recovery_, coalesce(ce, 0e0) as feat_ce_calculated,
          case when ce < 4.2e0 then 1 else 0 end as feat_ce_hypo_risk, case when ce > 4.3e0 then 1 else 0 end as feat_ce_hyper_risk,
          coalesce(c_ / nullif(si_, 0e0), 0e0) as feat_c_si_ratio, coalesce(mn_ / nullif(s_, 0e0), 0e0) as feat_mn_s_ratio,
          case when s_ > 2.5e-2 then 2 when s_ > 1.5e-2 then 1 else 0 end as feat_sulfur_risk,
          case when mg < 4e-1 then 1 else 0 end as feat_mg_recovery_risk,
          coalesce(tapping_temp - pouring_temp, 0e0) as feat_temp_loss,
          case when tapping_temp - pouring_temp > 8e1 then 1 else 0 end as feat_temp_loss_risk,
          (case when ce < 4.2e0 then 1.5e0 else 0e0 end) + (case when si_ < 2e0 then 1e0 else 0e0 end) as feat_shrinkage_risk_index,
          case when n__ > 8e-3 then 2e0 else 0e0 end as feat_gas_risk_index,
          round(coalesce(greatest(0e0, 3.5e0 - c_) + greatest(0e0, c_ - 3.8e0) + greatest(0e0, 2e0 - si_) + greatest(0e0, si_ - 2.8e0)
            + greatest(0e0, 1e-1 - mn_) + greatest(0e0, mn_ - 4e-1), 0e0), 9) as feat_chemistry_instability
        from (select *, c_ + (si_ + p__) / 3e0 as ce,
                case when (select avg(mg_recovery_ * 1e2) from heats) > 1e0 then mg_recovery_ * 1e2 / 1e2 else mg_recovery_ * 1e2 end as mg
              from heats)""", "heats"))
def f17_online_features(spark, sf_dir):
    """Online features of an upload whose Mg recovery comes in percent."""
    h = heats(spark, sf_dir).withColumn("mg_recovery_", F.col("mg_recovery_") * 100.0)
    out = FE.engineer_features_online(h).select(*HEAT_KEY, "mg_recovery_", *_ONLINE)
    return out.withColumn("feat_chemistry_instability", F.round("feat_chemistry_instability", 9))


# ---------------------------------------------------------------------------
# R*: rules
# ---------------------------------------------------------------------------
_RULE_SQL = {
    "r1_sulfur": ("greatest(case when s_ > 2.5e-2 then 3 when s_ > 1.5e-2 then 2 else 0 end, "
                  "case when mns < 2e0 then 2 when mns < 3e0 then 1 else 0 end)",
                  "case when s_ > 2.5e-2 then 3 when s_ > 1.5e-2 then 2 else 0 end"),
    "r2_carbon_equivalent": ("case when ce_use < 4.2e0 then 2 when ce_use > 4.3e0 then 1 else 0 end",
                             "case when ce_use < 4.2e0 then 2 else 0 end"),
    "r3_mg_recovery": ("case when mg_recovery_ < 3.5e-1 then 3 when mg_recovery_ < 4.5e-1 then 2 else 0 end",
                       "case when mg_recovery_ < 3.5e-1 then 3 when mg_recovery_ < 4.5e-1 then 1 else 0 end"),
    "r4_temperature": ("greatest(case when feat_temp_loss > 8e1 then 2 when feat_temp_loss > 5e1 then 1 else 0 end, "
                       "case when pouring_temp < 1.29e3 then 2 when pouring_temp > 1.48e3 then 1 else 0 end)",
                       "greatest(case when feat_temp_loss > 8e1 then 1 else 0 end, "
                       "case when pouring_temp < 1.29e3 then 2 else 0 end)"),
    "r5_shrinkage": ("case when feat_shrinkage_risk_index > 2.5e0 then 2 else 0 end", "0"),
    "r6_gas_porosity": ("case when feat_gas_risk_index > 1.5e0 then 1 else 0 end", "0"),
    "r7_ai_prediction": ("case when p >= 7.5e-1 then 3 when p >= 5e-1 then 2 when p >= 3e-1 then 1 else 0 end",
                         "case when p >= 7.5e-1 then 3 when p >= 5e-1 then 2 when p >= 3e-1 then 1 else 0 end"),
    "r8_anomaly": ("case when a >= 7.5e-1 then 3 when a >= 5.5e-1 then 2 else 0 end",
                   "case when a >= 8e-1 then 3 when a >= 5.5e-1 then 2 else 0 end"),
}
# which (risk, rec) entries of RuleOut belong to each rule, in build order
_RULE_SLOTS = {
    "r1_sulfur": ([0, 1], [0]),
    "r2_carbon_equivalent": ([2], [1]),
    "r3_mg_recovery": ([3], [2]),
    "r4_temperature": ([4, 5], [3, 4]),
    "r5_shrinkage": ([6], []),
    "r6_gas_porosity": ([7], []),
    "r7_ai_prediction": ([8], [5]),
    "r8_anomaly": ([9], [6]),
}


def _rule_query(name: str):
    risk_idx, rec_idx = _RULE_SLOTS[name]

    def q(spark, sf_dir):
        f = featured(spark, sf_dir)
        o = R.build_rules(f, clamp01_scalar(F.col("defect_prob")), clamp01_scalar(F.col("anomaly_score")))
        risk = R.escalate([o.risk[i] for i in risk_idx])
        rec = R.escalate([o.rec[i] for i in rec_idx]) if rec_idx else F.lit(0)
        return f.select(*HEAT_KEY, risk.alias("rule_risk_rank"), rec.alias("rule_rec_rank"))
    return q


for _name, (_risk_sql, _rec_sql) in _RULE_SQL.items():
    register(_name, decided_sql(
        f"select {KEY}, {_risk_sql} as rule_risk_rank, {_rec_sql} as rule_rec_rank from signals"))(_rule_query(_name))


@register("r9_escalation_lattice", decided_sql(
    "select rule_risk, rule_rec, count(*) as n_batches from ranks group by rule_risk, rule_rec"))
def r9_escalation_lattice(spark, sf_dir):
    f = featured(spark, sf_dir)
    risk, rec, _ = R.rule_ranks(f, clamp01_scalar(F.col("defect_prob")), clamp01_scalar(F.col("anomaly_score")))
    return f.groupBy(risk.alias("rule_risk"), rec.alias("rule_rec")).agg(F.count(F.lit(1)).alias("n_batches"))


@register("r10_rule_findings")
def r10_rule_findings(spark, sf_dir):
    out = R.interpret(spread_features(spark, sf_dir))
    return out.select(*HEAT_KEY, "risk_level", "recommendation",
                      F.array_join("warnings", " | ").alias("warnings"),
                      F.array_join("probable_causes", " | ").alias("probable_causes"),
                      F.array_join("recommendations", " | ").alias("recommendations"))


@register("r11_interpret_table", decided_sql(
    f"""select {KEY},
      case rule_risk when 0 then 'LOW' when 1 then 'MEDIUM' when 2 then 'HIGH' else 'CRITICAL' end as risk_level,
      case rule_rec when 0 then 'PROCEED' when 1 then 'MONITOR' when 2 then 'HOLD' else 'STOP' end as recommendation
    from ranks"""))
def r11_interpret_table(spark, sf_dir):
    return R.interpret(featured(spark, sf_dir), texts=False).select(*HEAT_KEY, "risk_level", "recommendation")


@register("r12_custom_thresholds", decided_sql(
    "select case when s_ > 2e-2 then 'CRITICAL' when s_ > 1e-2 then 'HIGH' else 'LOW' end as sulfur_level, "
    "count(*) as n_batches from signals group by 1"))
def r12_custom_thresholds(spark, sf_dir):
    f = featured(spark, sf_dir)
    o = R.build_rules(f, F.lit(0.0), F.lit(0.0), th={"s_critical": 0.02, "s_high": 0.01})
    lvl = F.coalesce(o.risk[0], F.lit(0))
    return f.groupBy(F.when(lvl == 3, "CRITICAL").when(lvl == 2, "HIGH").otherwise("LOW").alias("sulfur_level")) \
        .agg(F.count(F.lit(1)).alias("n_batches"))


# ---------------------------------------------------------------------------
# A7 / J1 / D*: decisions
# ---------------------------------------------------------------------------
@register("a7_cluster_decision_stats", with_fixtures(
    "select cast(cluster as int) as cluster, round(avg(cast(defect as double)), 9) as defect_rate, "
    "count(*) as batch_count, round(avg(anomaly_score), 9) as avg_anomaly, "
    "avg(cast(defect as double)) >= 2.2e-1 as risky from heats where cluster is not null group by 1", "heats"))
def a7_cluster_decision_stats(spark, sf_dir):
    s = D.cluster_stats(heats(spark, sf_dir))
    return s.select("cluster", F.round("defect_rate", 9).alias("defect_rate"), "batch_count",
                    F.round("avg_anomaly", 9).alias("avg_anomaly"), "risky")


@register("j1_cluster_lookup", decided_sql(
    f"select {KEY}, cluster, round(rate, 9) as cluster_defect_rate, risky as cluster_risky from signals"))
def j1_cluster_lookup(spark, sf_dir):
    f = featured(spark, sf_dir)
    out = D.attach_cluster_stats(f, D.cluster_stats(heats(spark, sf_dir)))
    return out.select(*HEAT_KEY, "cluster", F.round("cluster_defect_rate", 9).alias("cluster_defect_rate"),
                      "cluster_risky")


_DEC_COLS = "risk_level, recommendation, final_risk_score, risk_confidence, risk_factors"


@register("d1_unified_decision", decided_sql(f"select {KEY}, {_DEC_COLS} from final"))
def d1_unified_decision(spark, sf_dir):
    return decided(spark, sf_dir).select(*HEAT_KEY, "risk_level", "recommendation", "final_risk_score",
                                         "risk_confidence", "risk_factors")


@register("d2_consistency_overrides", decided_sql(
    "select risk_level, recommendation, count(*) as n_batches from final "
    "where risk_rank = 3 or a >= 8e-1 or p >= 5e-1 group by risk_level, recommendation"))
def d2_consistency_overrides(spark, sf_dir):
    d = decided(spark, sf_dir)
    p, a = clamp01_scalar(F.col("defect_prob")), clamp01_scalar(F.col("anomaly_score"))
    return d.where((F.col("risk_level") == "CRITICAL") | (a >= 0.8) | (p >= 0.5)) \
        .groupBy("risk_level", "recommendation").agg(F.count(F.lit(1)).alias("n_batches"))


@register("d3_final_risk_score", decided_sql(
    "select final_risk_score, count(*) as n_batches from final group by final_risk_score"))
def d3_final_risk_score(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("final_risk_score").agg(F.count(F.lit(1)).alias("n_batches"))


@register("d4_confidence", decided_sql(
    "select risk_confidence, count(*) as n_batches from final group by risk_confidence"))
def d4_confidence(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("risk_confidence").agg(F.count(F.lit(1)).alias("n_batches"))


@register("d5_risk_factors", decided_sql(
    f"select {KEY}, risk_factors from final"))
def d5_risk_factors(spark, sf_dir):
    return decided(spark, sf_dir).select(*HEAT_KEY, "risk_factors")


@register("d6_enriched_table")
def d6_enriched_table(spark, sf_dir):
    return D.enrich(spread_features(spark, sf_dir), stats=D.cluster_stats(heats(spark, sf_dir)),
                    row_key=F.col("l_orderkey")).select(
        *HEAT_KEY, "risk_level", "recommendation", "final_risk_score", "risk_confidence", "risk_factors",
        "qa_summary")


@register("d7_qa_report_lines")
def d7_qa_report_lines(spark, sf_dir):
    e = D.enrich(spread_features(spark, sf_dir), stats=D.cluster_stats(heats(spark, sf_dir)), row_key=F.col("l_orderkey"))
    lines = e.select(F.explode(F.split("qa_summary", "\n")).alias("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n_rows"))


@register("d8_report_consistency", with_fixtures("select true as all_consistent, count(*) as n_rows from heats",
                                                 "heats"))
def d8_report_consistency(spark, sf_dir):
    e = D.enrich(spread_features(spark, sf_dir), stats=D.cluster_stats(heats(spark, sf_dir)), row_key=F.col("l_orderkey"))
    return e.agg(F.bool_and(D.summary_matches_decision(e)).alias("all_consistent"),
                 F.count(F.lit(1)).alias("n_rows"))


@register("d9_refresh_guard", decided_sql(
    "select recommendation, count(*) as n_batches from final group by recommendation"))
def d9_refresh_guard(spark, sf_dir):
    e = D.ensure_decisions(decided(spark, sf_dir))  # stale (no qa_summary) -> re-enriched
    return e.groupBy("recommendation").agg(F.count(F.lit(1)).alias("n_batches"))


@register("d10_reason_lines", decided_sql(
    f"""select {KEY}, cast(pos - 1 as int) as pos, trim(reason) as reason from (
          select {KEY}, unnest(lines) as reason, generate_subscripts(lines, 1) as pos from (
            select {KEY}, case when trim(risk_factors) <> '' then list_filter(string_split(risk_factors, ';'), lambda x: trim(x) <> '')
              else ['Final recommendation: ' || recommendation, 'Risk level: ' || risk_level] end as lines from final))"""))
def d10_reason_lines(spark, sf_dir):
    return D.reason_lines(decided(spark, sf_dir), HEAT_KEY)


#: A raw upload's headers for the heats fixture.
_RAW_HEADERS = {
    "Carbon": "c_", "SI %": "si_", "Sulphur ": "s_", "Manganese": "mn_", "Phosphorus": "p__", "N": "n__", "AL": "al__",
    "Magnesium": "mg_", "CR": "cr_", "Mg Recovery %": "mg_recovery_", "Tapping Temperature": "tapping_temp", "Pour Temp": "pouring_temp",
    "CRCA": "crca", "FSMAddition MT": "fsmaddition_mt", "Heel": "heel", "Tapped Wt %": "tapped_wt_", "DEFECTED": "defect",
    "Defect Prob": "defect_prob", "Anomaly Score": "anomaly_score", "Cluster": "cluster"}


@register("d11_upload_chain", decided_sql(
    f"select {KEY}, risk_level, recommendation, final_risk_score, risk_confidence, risk_factors from final"))
def d11_upload_chain(spark, sf_dir):
    """A raw file (text values, raw headers, an empty column) through the whole upload chain."""
    from ..operators.upload import prepare_upload
    raw = heats(spark, sf_dir).select(*HEAT_KEY, *[F.col(c).cast("string").alias(h) for h, c in _RAW_HEADERS.items()],
                                      F.lit(None).cast("string").alias("Remarks"))
    out = prepare_upload(raw, keys=HEAT_KEY)
    return out.select(*HEAT_KEY, "risk_level", "recommendation", "final_risk_score", "risk_confidence", "risk_factors")
