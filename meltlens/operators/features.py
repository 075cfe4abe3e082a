"""Domain features (F0-F17) as pure column expressions.

A term contributes only when its input columns exist, so the expression list
is assembled on the driver from ``df.columns`` (metadata only).  Expressions
are added one dependency level at a time with ``withColumns`` -- two
projections in total instead of 28 chained ``withColumn`` calls.

The only non-row-local input is the median of ``mg_recovery_`` (F6).  It is
computed by one distributed exact-quantile job and attached as a one-row
cross join (a proven one-row broadcast), or taken from frozen training
statistics when ``mg_median`` is supplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import finite_or_null, flag, flag_d, safe_div, sentinel_to_numeric
from ..plans.ordered import median_row

K = config.FEATURE_CONST

FEATURE_ORDER = [
    "feat_ce_calculated",
    "feat_ce_hypo_risk", "feat_ce_hyper_risk", "feat_ce_optimal",
    "feat_c_si_ratio", "feat_c_si_risk",
    "feat_mn_s_ratio", "feat_mn_s_risk",
    "feat_sulfur_risk",
    "feat_mg_recovery_risk", "feat_mg_recovery_severe", "feat_mg_recovery_dev",
    "feat_temp_loss", "feat_temp_loss_risk", "feat_temp_loss_low",
    "feat_pouring_stability", "feat_pouring_risk",
    "feat_oxidation_risk",
    "feat_graphitization_index", "feat_white_iron_risk",
    "feat_shrinkage_risk_index",
    "feat_gas_risk_index",
    "feat_chemistry_instability", "feat_chemistry_ok",
    "feat_fsm_s_index", "feat_fsm_undertreat_risk",
    "feat_heel_ratio", "feat_heel_risk",
]


def _num(c: str, cols: set[str], df: DataFrame) -> Column:
    """Coerce a possibly-string column to double (``to_numeric(errors='coerce')``)."""
    dtype = dict(df.dtypes)[c]
    if dtype == "string":
        return sentinel_to_numeric(F.col(c))
    return F.col(c).cast("double")


def _ce_source(cols: set[str]) -> str | None:
    if {"c_", "si_", "p__"} <= cols:
        return "feat_ce_calculated"
    if "ce" in cols:
        return "ce"
    return None


def level1(df: DataFrame, mg_median: Column | None) -> dict[str, Column]:
    """Features that depend only on raw inputs."""
    cols = set(df.columns)
    c = F.col
    out: dict[str, Column] = {}
    # F1 carbon equivalent
    if {"c_", "si_", "p__"} <= cols:
        out["feat_ce_calculated"] = c("c_") + (c("si_") + c("p__")) / 3.0
    elif "ce" in cols:
        out["feat_ce_calculated"] = c("ce").cast("double")
    # F3 / F4 ratios (0-filled immediately)
    if {"c_", "si_"} <= cols:
        out["feat_c_si_ratio"] = safe_div(c("c_"), c("si_"))
    if {"mn_", "s_"} <= cols:
        out["feat_mn_s_ratio"] = safe_div(c("mn_"), c("s_"))
    # F5 sulfur ladder
    if "s_" in cols:
        out["feat_sulfur_risk"] = (
            F.when(c("s_") > K["sulfur_high"], 2).when(c("s_") > K["sulfur_mid"], 1).otherwise(0)
        )
    # F6 Mg recovery
    if "mg_recovery_" in cols:
        mg = c("mg_recovery_")
        out["feat_mg_recovery_risk"] = flag(mg < K["mg_rec_risk"])
        out["feat_mg_recovery_severe"] = flag(mg < K["mg_rec_severe"])
        if mg_median is not None:
            out["feat_mg_recovery_dev"] = F.abs(mg - mg_median)
    # F7 / F8 temperatures
    if {"tapping_temp", "pouring_temp"} <= cols:
        out["feat_temp_loss"] = c("tapping_temp") - c("pouring_temp")
    if "pouring_temp" in cols:
        out["feat_pouring_stability"] = (
            F.when(c("pouring_temp") < K["pour_cold"], -1).when(c("pouring_temp") > K["pour_hot"], 1).otherwise(0)
        )
    # F9 oxidation
    ox = F.lit(0.0)
    if "al__" in cols:
        ox = ox + flag_d(c("al__") > K["al_oxid"])
    if "pouring_temp" in cols:
        ox = ox + flag_d(c("pouring_temp") > K["pour_oxid"]) * 0.5
    out["feat_oxidation_risk"] = ox
    # F10 graphitisation (NULL input propagates, as in the reference)
    pos, neg = F.lit(0.0), F.lit(0.0)
    for name, w in config.GRAPHITIZATION_WEIGHTS:
        if name in cols:
            if w > 0:
                pos = pos + c(name) * w
            else:
                neg = neg + c(name) * (-w)
    out["feat_graphitization_index"] = pos - neg
    # F12 gas porosity
    gas = F.lit(0.0)
    if "n__" in cols:
        gas = gas + flag_d(c("n__") > K["gas_n"]) * 2.0
    if "mg_" in cols:
        gas = gas + flag_d(c("mg_") > K["gas_mg"])
    if "crca" in cols:
        gas = gas + flag_d(F.coalesce(_num("crca", cols, df), F.lit(0.0)) > K["gas_crca"]) * 0.5
    out["feat_gas_risk_index"] = gas
    # F13 chemistry instability: NULL input -> NULL score
    score = F.lit(0.0)
    for name, lo, hi in config.CHEMISTRY_RANGES:
        if name in cols:
            x = c(name)
            score = score + F.when(x < lo, lo - x).when(x > hi, x - hi).when(x.isNotNull(), F.lit(0.0))
    out["feat_chemistry_instability"] = score
    # F14 FSM efficiency
    if {"fsmaddition_mt", "s_"} <= cols:
        fsm = F.coalesce(_num("fsmaddition_mt", cols, df), F.lit(0.0))
        out["feat_fsm_s_index"] = safe_div(fsm, c("s_") * 100.0)
        out["feat_fsm_undertreat_risk"] = flag((fsm < K["fsm_low"]) & (c("s_") > K["fsm_s"]))
    # F15 heel ratio
    if {"heel", "tapped_wt_"} <= cols:
        heel = F.coalesce(_num("heel", cols, df), F.lit(0.0))
        tapped = F.coalesce(_num("tapped_wt_", cols, df), F.lit(1.0))
        out["feat_heel_ratio"] = safe_div(heel, tapped)
    return out


def level2(cols: set[str]) -> dict[str, Column]:
    """Features over level-1 results."""
    c = F.col
    out: dict[str, Column] = {}
    ce_col = "feat_ce_calculated" if "feat_ce_calculated" in cols else ("ce" if "ce" in cols else None)
    if ce_col:
        ce = c(ce_col)
        out["feat_ce_hypo_risk"] = flag(ce < K["ce_hypo"])
        out["feat_ce_hyper_risk"] = flag(ce > K["ce_hyper"])
        out["feat_ce_optimal"] = flag((ce >= K["ce_hypo"]) & (ce <= K["ce_hyper"]))
    if "feat_c_si_ratio" in cols:
        r = c("feat_c_si_ratio")
        out["feat_c_si_risk"] = flag((r < K["c_si_low"]) | (r > K["c_si_high"]))
    if "feat_mn_s_ratio" in cols:
        out["feat_mn_s_risk"] = flag(c("feat_mn_s_ratio") < K["mn_s_risk"])
    if "feat_temp_loss" in cols:
        out["feat_temp_loss_risk"] = flag(c("feat_temp_loss") > K["temp_loss_risk"])
        out["feat_temp_loss_low"] = flag(c("feat_temp_loss") < K["temp_loss_low"])
    if "feat_pouring_stability" in cols:
        out["feat_pouring_risk"] = flag(c("feat_pouring_stability") != 0)
    out["feat_white_iron_risk"] = flag(c("feat_graphitization_index") < 0)
    # F11 shrinkage
    sh = F.lit(0.0)
    if ce_col:
        sh = sh + flag_d(c(ce_col) < K["ce_hypo"]) * K["shrink_ce_w"]
    if "si_" in cols:
        sh = sh + flag_d(c("si_") < K["shrink_si"])
    if "pouring_temp" in cols:
        sh = sh + flag_d(c("pouring_temp") > K["shrink_pour"]) * 0.5
    out["feat_shrinkage_risk_index"] = sh
    out["feat_chemistry_ok"] = flag(c("feat_chemistry_instability") < K["chem_ok"])
    if "feat_heel_ratio" in cols:
        out["feat_heel_risk"] = flag(c("feat_heel_ratio") > K["heel_risk"])
    return out


def mg_median_row(df: DataFrame) -> DataFrame:
    """One-row frame ``med_mg_recovery_`` (exact, distributed)."""
    return median_row(df, ["mg_recovery_"], prefix="med_")


def engineer_features(df: DataFrame, mg_median: float | None = None, mg_deviation: bool = True) -> DataFrame:
    """F16: apply every feature in reference order and fill NULL features with 0.

    ``mg_median`` freezes the F6 median (training statistic); otherwise it is
    computed from ``df`` itself, as the reference does.  That takes a job over
    the table, so callers that do not use ``feat_mg_recovery_dev`` leave it out
    with ``mg_deviation=False``.
    """
    cols = set(df.columns)
    base = df
    med_col: Column | None = None
    if "mg_recovery_" in cols and (mg_deviation or mg_median is not None):
        if mg_median is None:
            # one exact, distributed median; the single value is folded in as a literal
            mg_median = mg_median_row(df).first()["med_mg_recovery_"]
        med_col = F.lit(mg_median).cast("double")
    l1 = base.withColumns(level1(base, med_col))
    l2 = l1.withColumns(level2(set(l1.columns)))
    feats = [f for f in FEATURE_ORDER if f in l2.columns]
    filled = l2.select(
        *[c for c in df.columns if c not in feats],
        *[F.coalesce(F.col(f), F.lit(0).cast(dict(l2.dtypes)[f])).alias(f) for f in feats],
    )
    return filled


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("feat_")]


# ---------------------------------------------------------------------------
# reduced "online" re-engineering (opt-in compatibility mode, T7)
# ---------------------------------------------------------------------------
def repaired_share(df: DataFrame, column: str) -> Column:
    """A share given as text or percent: '%' and ',' dropped, all divided by 100 when the mean is above 1."""
    value = sentinel_to_numeric(F.col(column), strip_percent=True) if dict(df.dtypes)[column] == "string" \
        else finite_or_null(F.col(column).cast("double"))
    mean = df.agg(F.avg(value).alias("m")).first()["m"]
    return value / 100.0 if (mean or 0.0) > 1.0 else value


def engineer_features_online(df: DataFrame) -> DataFrame:
    """overwrite a subset of features with the reduced online formulas.

    Mg recovery is repaired to a share first.  Shrinkage loses its pouring term,
    gas its Mg and CRCA terms, chemistry instability its Mg range; NULL features
    become 0.
    """
    cols = set(df.columns)
    if "mg_recovery_" in cols:
        df = df.withColumn("mg_recovery_", repaired_share(df, "mg_recovery_"))
    c = F.col
    out: dict[str, Column] = {}
    ce: Column | None = c("feat_ce_calculated") if "feat_ce_calculated" in cols else None
    if {"c_", "si_", "p__"} <= cols:
        ce = out["feat_ce_calculated"] = c("c_") + (c("si_") + c("p__")) / 3.0
    elif "ce" in cols:
        ce = out["feat_ce_calculated"] = c("ce").try_cast("double")
    if ce is not None:
        out["feat_ce_hypo_risk"] = flag(ce < K["ce_hypo"])
        out["feat_ce_hyper_risk"] = flag(ce > K["ce_hyper"])
    if {"c_", "si_"} <= cols:
        out["feat_c_si_ratio"] = safe_div(c("c_"), c("si_"))
    if {"mn_", "s_"} <= cols:
        out["feat_mn_s_ratio"] = safe_div(c("mn_"), c("s_"))
    if "s_" in cols:
        out["feat_sulfur_risk"] = F.when(c("s_") > K["sulfur_high"], 2).when(c("s_") > K["sulfur_mid"], 1).otherwise(0)
    out["feat_mg_recovery_risk"] = flag(c("mg_recovery_") < K["mg_rec_risk"]) if "mg_recovery_" in cols else F.lit(0)
    if {"tapping_temp", "pouring_temp"} <= cols:
        out["feat_temp_loss"] = c("tapping_temp") - c("pouring_temp")
        out["feat_temp_loss_risk"] = flag(out["feat_temp_loss"] > K["temp_loss_risk"])
    shrinkage = F.lit(0.0)
    if ce is not None:
        shrinkage = shrinkage + flag_d(ce < K["ce_hypo"]) * K["shrink_ce_w"]
    if "si_" in cols:
        shrinkage = shrinkage + flag_d(c("si_") < K["shrink_si"])
    out["feat_shrinkage_risk_index"] = shrinkage
    out["feat_gas_risk_index"] = flag_d(c("n__") > K["gas_n"]) * 2.0 if "n__" in cols else F.lit(0.0)
    outside = F.lit(0.0)
    for name, lo, hi in config.CHEMISTRY_RANGES:
        if name in cols and name != "mg_":
            x = c(name)
            outside = outside + F.when(x < lo, lo - x).when(x > hi, x - hi).when(x.isNotNull(), F.lit(0.0))
    out["feat_chemistry_instability"] = outside
    return df.withColumns(out).fillna(0, subset=[f for f in {*cols, *out} if f.startswith("feat_")])
