"""Rule engine (R1-R12) as one projection.

Every rule is a CASE ladder producing (risk rank, recommendation rank) and
its ordered texts.  Escalation (R9) is ``greatest`` over ranks; the ordered
text lists (R10) are ``array_compact(array(...))`` in fixed rule order, so no
``collect_list`` ordering is relied upon and nothing leaves the JVM.

Ranks: risk LOW=0 MEDIUM=1 HIGH=2 CRITICAL=3; recommendation
PROCEED=0 MONITOR=1 HOLD=2 STOP=3 (higher = more severe).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import compact_array, label_of
from ..plans.lookup import own_stage
from ..functions.text import fmt

REC_BY_SEVERITY = ["PROCEED", "MONITOR", "HOLD", "STOP"]  # index = severity rank

# ---------------------------------------------------------------------------
# FIXED VALUES — rule texts (suffixes appended after the formatted value)
# ---------------------------------------------------------------------------
TXT = {
    "s_crit_w": " Severe nodularisation failure expected.",
    "s_crit_c": ("Excessive sulfur from contaminated scrap, CRCA, or inadequate desulfurisation. "
                 "Mg treatment severely depleted by S."),
    "s_crit_a": "STOP this heat. Investigate charge materials and desulfurisation.",
    "s_high_w": " Nodularisation efficiency compromised.",
    "s_high_c": "Elevated sulfur from charge or poor bath control.",
    "s_high_a": "Increase FSM dosage or consider re-treatment. Monitor nodule count.",
    "mns_low_w": " Insufficient manganese to neutralise sulfur.",
    "mns_low_c": "Low Mn addition or excessive S build-up.",
    "mns_low_a": "Add manganese alloy; target Mn/S ≥ 3.",
    "ce_hypo_w": " Micro-shrinkage and hard spots likely.",
    "ce_hypo_c": "Insufficient carbon or silicon in charge.",
    "ce_hypo_a": "Increase carbon addition. Check graphite/carburiser additions. ",
    "ce_hyper_w": " Graphite flotation and surface defects possible.",
    "ce_hyper_c": "Excess carbon or silicon, possibly from high heel content.",
    "mg_low_w": " Flake or vermicular graphite highly probable.",
    "mg_low_c": ("Excessive sulfur consumption of Mg, high pouring temperature, "
                 "long treatment-to-pour time, or insufficient FSM dose."),
    "mg_low_a": ("STOP or conduct microscopy. Investigate treatment protocol. "
                 "Check FSM wire speed and wire chemistry."),
    "mg_warn_w": " Reduced nodularity expected.",
    "mg_warn_a": "Increase FSM dosage. Verify treatment timing.",
    "loss_high_w": " High risk of cold shut, mis-run, and ladle lining erosion.",
    "loss_high_c": "Poor ladle insulation, long transfer time, or crane delay.",
    "loss_high_a": "Pre-heat ladle. Reduce transfer time. Check ladle cover usage.",
    "pour_low_w": " Incomplete filling and cold shuts expected.",
    "pour_high_w": " Oxidation, gas porosity, and coarse grain risk.",
    "pour_high_a": "Allow controlled cooling before pouring.",
    "shrink_w": " Significant volumetric shrinkage expected during solidification.",
    "shrink_c": ("Hypoeutectic CE, low Si, or excessive pouring temperature — "
                 "all reduce graphite expansion that compensates shrinkage."),
    "shrink_a": "Review risering design. Increase Si within limits. Adjust CE toward eutectic.",
    "gas_w": " Hydrogen/nitrogen blowholes or Mg vapour pockets possible.",
    "gas_c": "Moisture in charge (CRCA, SG Pig), elevated N%, or over-treatment with Mg.",
    "gas_a": "Dry all charge materials. Check bath N%. Verify Mg addition rate.",
    "ai_crit_w": " Multiple process factors converging toward defect.",
    "anom_crit_w": " Process pattern is radically different from all historical normal batches.",
    "anom_high_w": " Unusual process behaviour detected.",
}


def _t(v: float) -> str:
    """Threshold as the reference prints it (integers without a decimal point)."""
    v = float(v)
    return str(int(v)) if v.is_integer() else repr(v)


def _pct0(v: float) -> str:
    """``{v:.0%}`` as it must appear inside a format pattern (percent escaped)."""
    return f"{round(v * 100):d}%%"


def _fmt(pattern: str, *cols: Column) -> Column:
    return fmt(pattern, *cols)


@dataclass
class RuleOut:
    risk: list[Column] = field(default_factory=list)
    rec: list[Column] = field(default_factory=list)
    warnings: list[Column] = field(default_factory=list)
    causes: list[Column] = field(default_factory=list)
    actions: list[Column] = field(default_factory=list)


def _num_or_null(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("double")
    return F.col(name).try_cast("double")


def build_rules(df: DataFrame, prob: Column, anomaly: Column, th: dict | None = None) -> RuleOut:
    """R1-R8 as column ladders.  ``prob``/``anomaly`` are already in [0, 1]."""
    t = dict(config.RULE_THRESH, **(th or {}))
    o = RuleOut()
    s, mn = _num_or_null(df, "s_"), _num_or_null(df, "mn_")
    # R1 sulfur
    s_crit, s_high = s > t["s_critical"], s > t["s_high"]
    o.risk.append(F.when(s_crit, 3).when(s_high, 2))
    o.rec.append(F.when(s_crit, 3).when(s_high, 2))
    o.warnings.append(
        F.when(s_crit, F.concat(_fmt(f"CRITICAL: Sulfur = %.4f%% (limit {_t(t['s_critical'])}%%).", s), F.lit(TXT["s_crit_w"])))
        .when(s_high, F.concat(_fmt(f"HIGH: Sulfur = %.4f%% (warning >{_t(t['s_high'])}%%).", s), F.lit(TXT["s_high_w"])))
    )
    o.causes.append(F.when(s_crit, F.lit(TXT["s_crit_c"])).when(s_high, F.lit(TXT["s_high_c"])))
    o.actions.append(F.when(s_crit, F.lit(TXT["s_crit_a"])).when(s_high, F.lit(TXT["s_high_a"])))
    mns = F.when(s.isNotNull() & mn.isNotNull() & (s > 0), mn / s)
    mns_low, mns_warn = mns < t["mn_s_low"], mns < t["mn_s_warn"]
    o.risk.append(F.when(mns_low, 2).when(mns_warn, 1))
    o.warnings.append(
        F.when(mns_low, F.concat(_fmt("Mn/S ratio = %.1f (dangerously low, require >3).", mns), F.lit(TXT["mns_low_w"])))
        .when(mns_warn, _fmt(f"Mn/S ratio = %.1f (below recommended {t['mn_s_warn']:.1f}).", mns))
    )
    o.causes.append(F.when(mns_low, F.lit(TXT["mns_low_c"])))
    o.actions.append(F.when(mns_low, F.lit(TXT["mns_low_a"])))
    # R2 carbon equivalent: a 0.0 calculated CE falls through to `ce`
    ce_calc = _num_or_null(df, "feat_ce_calculated")
    ce = F.when(ce_calc.isNotNull() & (ce_calc != 0), ce_calc).otherwise(_num_or_null(df, "ce"))
    hypo, hyper = ce < t["ce_hypo"], ce > t["ce_hyper"]
    o.risk.append(F.when(hypo, 2).when(hyper, 1))
    o.rec.append(F.when(hypo, 2))
    o.warnings.append(
        F.when(hypo, F.concat(_fmt("CE = %.3f  (hypoeutectic, %.3f below eutectic).", ce, F.lit(t["ce_hypo"]) - ce), F.lit(TXT["ce_hypo_w"])))
        .when(hyper, F.concat(_fmt("CE = %.3f  (hypereutectic, %.3f above eutectic).", ce, ce - F.lit(t["ce_hyper"])), F.lit(TXT["ce_hyper_w"])))
    )
    o.causes.append(F.when(hypo, F.lit(TXT["ce_hypo_c"])).when(hyper, F.lit(TXT["ce_hyper_c"])))
    o.actions.append(
        F.when(hypo, F.lit(TXT["ce_hypo_a"] + f"Target CE ≥ {_t(t['ce_hypo'])}."))
        .when(hyper, F.lit(f"Reduce carbon addition. Target CE ≤ {_t(t['ce_hyper'])}."))
    )
    # R3 Mg recovery
    mg = _num_or_null(df, "mg_recovery_")
    mg_low, mg_warn = mg < t["mg_rec_low"], mg < t["mg_rec_warn"]
    o.risk.append(F.when(mg_low, 3).when(mg_warn, 2))
    o.rec.append(F.when(mg_low, 3).when(mg_warn, 1))
    o.warnings.append(
        F.when(mg_low, F.concat(_fmt(f"CRITICAL: Mg recovery = %.2f%%. Severely below target {_pct0(t['mg_rec_low'])}.",
                            mg * 100.0), F.lit(TXT["mg_low_w"])))
        .when(mg_warn, F.concat(_fmt(f"Mg recovery = %.2f%% (below recommended {_pct0(t['mg_rec_warn'])}).", mg * 100.0), F.lit(TXT["mg_warn_w"])))
    )
    o.causes.append(F.when(mg_low, F.lit(TXT["mg_low_c"])))
    o.actions.append(F.when(mg_low, F.lit(TXT["mg_low_a"])).when(mg_warn, F.lit(TXT["mg_warn_a"])))
    # R4 temperature
    loss, pour = _num_or_null(df, "feat_temp_loss"), _num_or_null(df, "pouring_temp")
    l_high, l_warn = loss > t["temp_loss_high"], loss > t["temp_loss_warn"]
    o.risk.append(F.when(l_high, 2).when(l_warn, 1))
    o.rec.append(F.when(l_high, 1))
    o.warnings.append(
        F.when(l_high, F.concat(_fmt(f"Temperature loss = %.0f°C (critical, >{_t(t['temp_loss_high'])}°C).", loss), F.lit(TXT["loss_high_w"])))
        .when(l_warn, _fmt(f"Temperature loss = %.0f°C (elevated, >{_t(t['temp_loss_warn'])}°C).", loss))
    )
    o.causes.append(F.when(l_high, F.lit(TXT["loss_high_c"])))
    o.actions.append(F.when(l_high, F.lit(TXT["loss_high_a"])))
    p_low, p_high = pour < t["pour_temp_low"], pour > t["pour_temp_high"]
    o.risk.append(F.when(p_low, 2).when(p_high, 1))
    o.rec.append(F.when(p_low, 2))
    o.warnings.append(
        F.when(p_low, F.concat(_fmt(f"Pouring temperature = %.0f°C (cold pour, <{_t(t['pour_temp_low'])}°C).", pour), F.lit(TXT["pour_low_w"])))
        .when(p_high, F.concat(_fmt(f"Pouring temperature = %.0f°C (overheated, >{_t(t['pour_temp_high'])}°C).", pour), F.lit(TXT["pour_high_w"])))
    )
    o.actions.append(F.when(p_high, F.lit(TXT["pour_high_a"])))
    # R5 shrinkage, R6 gas
    sh = _num_or_null(df, "feat_shrinkage_risk_index")
    sh_hit = sh > t["shrinkage_high"]
    o.risk.append(F.when(sh_hit, 2))
    o.warnings.append(F.when(sh_hit, F.concat(_fmt("Shrinkage risk index = %.2f.", sh), F.lit(TXT["shrink_w"]))))
    o.causes.append(F.when(sh_hit, F.lit(TXT["shrink_c"])))
    o.actions.append(F.when(sh_hit, F.lit(TXT["shrink_a"])))
    gas = _num_or_null(df, "feat_gas_risk_index")
    gas_hit = gas > t["gas_medium"]
    o.risk.append(F.when(gas_hit, 1))
    o.warnings.append(F.when(gas_hit, F.concat(_fmt("Gas porosity risk index = %.2f.", gas), F.lit(TXT["gas_w"]))))
    o.causes.append(F.when(gas_hit, F.lit(TXT["gas_c"])))
    o.actions.append(F.when(gas_hit, F.lit(TXT["gas_a"])))
    # R7 classifier probability
    p = prob
    p_c, p_h, p_m = p >= t["defect_prob_crit"], p >= t["defect_prob_high"], p >= t["defect_prob_med"]
    o.risk.append(F.when(p_c, 3).when(p_h, 2).when(p_m, 1))
    o.rec.append(F.when(p_c, 3).when(p_h, 2).when(p_m, 1))
    o.warnings.append(
        F.when(p_c, F.concat(_fmt("AI PREDICTION: %.1f%% defect probability (CRITICAL).", p * 100.0), F.lit(TXT["ai_crit_w"])))
        .when(p_h, _fmt("AI PREDICTION: %.1f%% defect probability (HIGH RISK).", p * 100.0))
        .when(p_m, _fmt("AI PREDICTION: %.1f%% defect probability (MONITOR).", p * 100.0))
    )
    # R8 anomaly
    a = anomaly
    a_s, a_c, a_h = a >= t["anomaly_stop"], a >= t["anomaly_crit"], a >= t["anomaly_high"]
    o.risk.append(F.when(a_s, 3).when(a_c, 3).when(a_h, 2))
    o.rec.append(F.when(a_s, 3).when(a_c, 2).when(a_h, 2))
    o.warnings.append(
        F.when(a_c, F.concat(_fmt("ANOMALY: Score = %.2f (CRITICAL).", a), F.lit(TXT["anom_crit_w"])))
        .when(a_h, F.concat(_fmt("ANOMALY: Score = %.2f (HIGH).", a), F.lit(TXT["anom_high_w"])))
    )
    return o


def escalate(ranks: list[Column]) -> Column:
    """Worst-of lattice over rank columns (NULL = rule not fired)."""
    return F.coalesce(F.greatest(*[F.coalesce(r, F.lit(0)) for r in ranks]), F.lit(0)) if len(ranks) > 1 \
        else F.coalesce(ranks[0], F.lit(0))


def interpret(df: DataFrame, prob_col: str | None = "defect_prob", anomaly_col: str | None = "anomaly_score",
              th: dict | None = None, texts: bool = True) -> DataFrame:
    """All rules on every row -> ``risk_level``, ``recommendation`` and
    the ordered ``warnings`` / ``probable_causes`` / ``recommendations`` lists.

    Probability and anomaly default to 0 when absent (as in the reference).
    """
    from ..functions.scalar import clamp01_scalar

    prob = clamp01_scalar(F.col(prob_col)) if prob_col and prob_col in df.columns else F.lit(0.0)
    anom = clamp01_scalar(F.col(anomaly_col)) if anomaly_col and anomaly_col in df.columns else F.lit(0.0)
    # signals once per row; the ranks and the texts are each compiled for themselves
    signals = df.withColumns({"__p": prob, "__a": anom})
    if texts:
        signals = own_stage(signals)
    o = build_rules(signals, F.col("__p"), F.col("__a"), th)
    out = signals.withColumns({"__risk": escalate(o.risk), "__rec": escalate(o.rec)})
    if texts:
        out = own_stage(own_stage(out).withColumns({
            "warnings": compact_array(o.warnings), "probable_causes": compact_array(o.causes),
            "recommendations": compact_array(o.actions)}))
    return out.withColumns({
        "risk_level": label_of(F.col("__risk"), config.RISK_ORDER),
        "recommendation": label_of(F.col("__rec"), REC_BY_SEVERITY),
    }).drop("__risk", "__rec", "__p", "__a")


def rule_ranks(df: DataFrame, prob: Column, anomaly: Column, th: dict | None = None) -> tuple[Column, Column, RuleOut]:
    o = build_rules(df, prob, anomaly, th)
    return escalate(o.risk), escalate(o.rec), o
