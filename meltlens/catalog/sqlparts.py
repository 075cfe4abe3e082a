"""Shared DuckDB SQL fragments for the oracle twins.

Written independently of the Spark code as plain SQL; floating literals are
in exponent form so DuckDB types them DOUBLE, like Spark.
"""

from __future__ import annotations

from ..sources.fixtures import with_fixtures

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

# all 28 features over heats (F1-F16), median of mg_recovery_ from the frame
FEATURES_BODY = """select h.*,
  coalesce(c_ + (si_ + p__)/3e0, 0e0) as feat_ce_calculated,
  case when c_ + (si_ + p__)/3e0 < 4.2e0 then 1 else 0 end as feat_ce_hypo_risk,
  case when c_ + (si_ + p__)/3e0 > 4.3e0 then 1 else 0 end as feat_ce_hyper_risk,
  case when c_ + (si_ + p__)/3e0 >= 4.2e0 and c_ + (si_ + p__)/3e0 <= 4.3e0 then 1 else 0 end as feat_ce_optimal,
  coalesce(c_ / nullif(si_, 0e0), 0e0) as feat_c_si_ratio,
  case when coalesce(c_ / nullif(si_, 0e0), 0e0) < 1.4e0 or coalesce(c_ / nullif(si_, 0e0), 0e0) > 2e0 then 1 else 0 end as feat_c_si_risk,
  coalesce(mn_ / nullif(s_, 0e0), 0e0) as feat_mn_s_ratio,
  case when coalesce(mn_ / nullif(s_, 0e0), 0e0) < 2e0 then 1 else 0 end as feat_mn_s_risk,
  case when s_ > 2.5e-2 then 2 when s_ > 1.5e-2 then 1 else 0 end as feat_sulfur_risk,
  case when mg_recovery_ < 4e-1 then 1 else 0 end as feat_mg_recovery_risk,
  case when mg_recovery_ < 3e-1 then 1 else 0 end as feat_mg_recovery_severe,
  coalesce(abs(mg_recovery_ - m.med_mg), 0e0) as feat_mg_recovery_dev,
  coalesce(tapping_temp - pouring_temp, 0e0) as feat_temp_loss,
  case when tapping_temp - pouring_temp > 8e1 then 1 else 0 end as feat_temp_loss_risk,
  case when tapping_temp - pouring_temp < 2e1 then 1 else 0 end as feat_temp_loss_low,
  case when pouring_temp < 1.3e3 then -1 when pouring_temp > 1.5e3 then 1 else 0 end as feat_pouring_stability,
  case when pouring_temp < 1.3e3 or pouring_temp > 1.5e3 then 1 else 0 end as feat_pouring_risk,
  (case when al__ > 2e-2 then 1e0 else 0e0 end) + (case when pouring_temp > 1.45e3 then 1e0 else 0e0 end) * 5e-1 as feat_oxidation_risk,
  coalesce(si_*2e0 - (cr_*3.5e0 + mn_*3e-1), 0e0) as feat_graphitization_index,
  case when si_*2e0 - (cr_*3.5e0 + mn_*3e-1) < 0e0 then 1 else 0 end as feat_white_iron_risk,
  (case when c_ + (si_ + p__)/3e0 < 4.2e0 then 1e0 else 0e0 end) * 1.5e0
    + (case when si_ < 2e0 then 1e0 else 0e0 end)
    + (case when pouring_temp > 1.42e3 then 1e0 else 0e0 end) * 5e-1 as feat_shrinkage_risk_index,
  (case when n__ > 8e-3 then 1e0 else 0e0 end) * 2e0
    + (case when mg_ > 5.5e-2 then 1e0 else 0e0 end)
    + (case when coalesce(crca, 0e0) > 5e1 then 1e0 else 0e0 end) * 5e-1 as feat_gas_risk_index,
  coalesce(((case when c_ < 3.5e0 then 3.5e0 - c_ when c_ > 3.8e0 then c_ - 3.8e0 else 0e0 end)
    + (case when si_ < 2e0 then 2e0 - si_ when si_ > 2.8e0 then si_ - 2.8e0 else 0e0 end))
    + (case when mn_ < 1e-1 then 1e-1 - mn_ when mn_ > 4e-1 then mn_ - 4e-1 else 0e0 end)
    + (case when mg_ < 3e-2 then 3e-2 - mg_ when mg_ > 5.5e-2 then mg_ - 5.5e-2 else 0e0 end), 0e0)
    as feat_chemistry_instability,
  case when ((case when c_ < 3.5e0 then 3.5e0 - c_ when c_ > 3.8e0 then c_ - 3.8e0 else 0e0 end)
    + (case when si_ < 2e0 then 2e0 - si_ when si_ > 2.8e0 then si_ - 2.8e0 else 0e0 end))
    + (case when mn_ < 1e-1 then 1e-1 - mn_ when mn_ > 4e-1 then mn_ - 4e-1 else 0e0 end)
    + (case when mg_ < 3e-2 then 3e-2 - mg_ when mg_ > 5.5e-2 then mg_ - 5.5e-2 else 0e0 end) < 1e-1
    then 1 else 0 end as feat_chemistry_ok,
  coalesce(coalesce(fsmaddition_mt, 0e0) / nullif(s_*1e2, 0e0), 0e0) as feat_fsm_s_index,
  case when coalesce(fsmaddition_mt, 0e0) < 8e0 and s_ > 1.2e-2 then 1 else 0 end as feat_fsm_undertreat_risk,
  coalesce(coalesce(heel, 0e0) / nullif(coalesce(tapped_wt_, 1e0), 0e0), 0e0) as feat_heel_ratio,
  case when coalesce(coalesce(heel, 0e0) / nullif(coalesce(tapped_wt_, 1e0), 0e0), 0e0) > 5e-1 then 1 else 0 end as feat_heel_risk
from heats h cross join (select median(mg_recovery_) as med_mg from heats) m"""

FEATURE_COLS = [
    "feat_ce_calculated", "feat_ce_hypo_risk", "feat_ce_hyper_risk", "feat_ce_optimal",
    "feat_c_si_ratio", "feat_c_si_risk", "feat_mn_s_ratio", "feat_mn_s_risk", "feat_sulfur_risk",
    "feat_mg_recovery_risk", "feat_mg_recovery_severe", "feat_mg_recovery_dev",
    "feat_temp_loss", "feat_temp_loss_risk", "feat_temp_loss_low", "feat_pouring_stability", "feat_pouring_risk",
    "feat_oxidation_risk", "feat_graphitization_index", "feat_white_iron_risk", "feat_shrinkage_risk_index",
    "feat_gas_risk_index", "feat_chemistry_instability", "feat_chemistry_ok", "feat_fsm_s_index",
    "feat_fsm_undertreat_risk", "feat_heel_ratio", "feat_heel_risk",
]

# per-row signal + rule ranks over `feat` (requires `feat` CTE from FEATURES_BODY)
SIGNALS_BODY = """select f.*,
  case when defect_prob is null or isnan(defect_prob) or isinf(defect_prob) then 0e0
       else greatest(0e0, least(1e0, case when defect_prob > 1e0 then (case when defect_prob <= 1e2 then defect_prob/1e2 else 1e0 end) else defect_prob end)) end as p,
  case when anomaly_score is null or isnan(anomaly_score) or isinf(anomaly_score) then 0e0
       else greatest(0e0, least(1e0, case when anomaly_score > 1e0 then (case when anomaly_score <= 1e2 then anomaly_score/1e2 else 1e0 end) else anomaly_score end)) end as a,
  coalesce(cs.rate, 0e0) as rate,
  coalesce(cs.rate >= 2.2e-1, false) as risky,
  case when feat_ce_calculated is not null and feat_ce_calculated <> 0e0 then feat_ce_calculated end as ce_use,
  case when s_ is not null and mn_ is not null and s_ > 0e0 then mn_ / s_ end as mns
from feat f left join (select cluster as cl, avg(cast(coalesce(defect, 0) as double)) as rate
                       from feat where cluster is not null group by cluster) cs
  on coalesce(cast(f.cluster as int), -1) = cs.cl"""

RANKS_BODY = """select s.*,
  greatest(
    case when s_ > 2.5e-2 then 3 when s_ > 1.5e-2 then 2 else 0 end,
    case when mns < 2e0 then 2 when mns < 3e0 then 1 else 0 end,
    case when ce_use < 4.2e0 then 2 when ce_use > 4.3e0 then 1 else 0 end,
    case when mg_recovery_ < 3.5e-1 then 3 when mg_recovery_ < 4.5e-1 then 2 else 0 end,
    case when feat_temp_loss > 8e1 then 2 when feat_temp_loss > 5e1 then 1 else 0 end,
    case when pouring_temp < 1.29e3 then 2 when pouring_temp > 1.48e3 then 1 else 0 end,
    case when feat_shrinkage_risk_index > 2.5e0 then 2 else 0 end,
    case when feat_gas_risk_index > 1.5e0 then 1 else 0 end,
    case when p >= 7.5e-1 then 3 when p >= 5e-1 then 2 when p >= 3e-1 then 1 else 0 end,
    case when a >= 7.5e-1 then 3 when a >= 5.5e-1 then 2 else 0 end) as rule_risk,
  greatest(
    case when s_ > 2.5e-2 then 3 when s_ > 1.5e-2 then 2 else 0 end,
    case when ce_use < 4.2e0 then 2 else 0 end,
    case when mg_recovery_ < 3.5e-1 then 3 when mg_recovery_ < 4.5e-1 then 1 else 0 end,
    case when feat_temp_loss > 8e1 then 1 else 0 end,
    case when pouring_temp < 1.29e3 then 2 else 0 end,
    case when p >= 7.5e-1 then 3 when p >= 5e-1 then 2 when p >= 3e-1 then 1 else 0 end,
    case when a >= 8e-1 then 3 when a >= 5.5e-1 then 2 else 0 end) as rule_rec,
  case when p >= 7.5e-1 then 3 when p >= 5e-1 then 2 when p >= 3e-1 then 1 else 0 end as p_lvl,
  case when a >= 8e-1 then 3 when a >= 6e-1 then 2 when a >= 4e-1 then 1 else 0 end as a_lvl,
  case when rate >= 4e-1 then 3 when risky then 2 else 0 end as c_lvl
from signals s"""

DECIDED_BODY = """select r.*,
  greatest(p_lvl, a_lvl, c_lvl, rule_risk) as risk_rank,
  greatest(p_lvl, a_lvl, c_lvl, rule_rec) as rec0,
  concat_ws('; ',
    case when p >= 7.5e-1 then printf('Defect probability %.1f%% (critical)', p*1e2)
         when p >= 5e-1 then printf('Defect probability %.1f%% (high)', p*1e2)
         when p >= 3e-1 then printf('Defect probability %.1f%% (elevated)', p*1e2) end,
    case when a >= 8e-1 then printf('Anomaly score %.2f (critical pattern)', a)
         when a >= 6e-1 then printf('Anomaly score %.2f (unusual process)', a)
         when a >= 4e-1 then printf('Anomaly score %.2f (monitor)', a) end,
    case when rate >= 4e-1 then printf('Cluster %d historical defect rate %.1f%%', coalesce(cast(cluster as int), -1), rate*1e2)
         when risky then printf('Cluster %d elevated historical risk (%.1f%%)', coalesce(cast(cluster as int), -1), rate*1e2) end
  ) as risk_factors,
  (case when p >= 3e-1 then 1 else 0 end) + (case when a >= 4e-1 then 1 else 0 end) + (case when rate >= 1.1e-1 then 1 else 0 end) as n_high,
  (case when p >= 3e-1 then 1 else 0 end) + (case when a >= 4e-1 then 1 else 0 end) + (case when rate >= 4e-1 or risky then 1 else 0 end) as n_factors
from ranks r"""

FINAL_BODY = """select d.*,
  case risk_rank when 0 then 'LOW' when 1 then 'MEDIUM' when 2 then 'HIGH' else 'CRITICAL' end as risk_level,
  case (case when rec0 = 0 and ((risk_rank = 3) or a >= 8e-1) then 3
             when rec0 = 0 and p >= 5e-1 then 2
             when rec0 = 1 and risk_rank = 3 then 2 else rec0 end)
    when 0 then 'PROCEED' when 1 then 'MONITOR' when 2 then 'HOLD' else 'STOP' end as recommendation,
  round(greatest(p, a, rate) * 1e2, 1) as final_risk_score,
  round(least(9.5e-1, 4.5e-1 + 1.8e-1*n_high + 1.2e-1*n_factors), 2) as risk_confidence
from decided d"""


def decided_sql(select: str) -> str:
    """Full decision chain over heats as CTEs, then ``select``."""
    return with_fixtures(select, "heats", ctes={
        "feat": FEATURES_BODY,
        "signals": SIGNALS_BODY,
        "ranks": RANKS_BODY,
        "decided": DECIDED_BODY,
        "final": FINAL_BODY,
    })


def features_sql(select: str, extra: dict[str, str] | None = None) -> str:
    ctes = {"feat": FEATURES_BODY}
    ctes.update(extra or {})
    return with_fixtures(select, "heats", ctes=ctes)
