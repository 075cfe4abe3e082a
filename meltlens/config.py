"""Fixed values that must equal the reference for identical decisions.

Everything in this module is configuration (thresholds, enum orders, name
lists).  Operators receive these as ``lit()`` values so Catalyst folds them.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — rule thresholds (per-rule engine)
# ---------------------------------------------------------------------------
RULE_THRESH = {
    "s_high": 0.015,
    "s_critical": 0.025,
    "mn_s_low": 2.0,
    "mn_s_warn": 3.0,
    "ce_hypo": 4.20,
    "ce_hyper": 4.30,
    "mg_rec_low": 0.35,
    "mg_rec_warn": 0.45,
    "temp_loss_high": 80.0,
    "temp_loss_warn": 50.0,
    "pour_temp_low": 1290.0,
    "pour_temp_high": 1480.0,
    "defect_prob_crit": 0.75,
    "defect_prob_high": 0.50,
    "defect_prob_med": 0.30,
    "anomaly_stop": 0.80,
    "anomaly_crit": 0.75,
    "anomaly_high": 0.55,
    "shrinkage_high": 2.5,
    "gas_medium": 1.5,
}

# ---------------------------------------------------------------------------
# FIXED VALUES — unified decision thresholds
# ---------------------------------------------------------------------------
DECISION_THRESH = {
    "defect_stop": 0.75,
    "defect_hold": 0.50,
    "defect_monitor": 0.30,
    "anomaly_stop": 0.80,
    "anomaly_hold": 0.60,
    "anomaly_monitor": 0.40,
    "cluster_stop_rate": 0.40,
    "cluster_hold_rate": 0.22,
}

# ---------------------------------------------------------------------------
# FIXED VALUES — ordered vocabularies
# ---------------------------------------------------------------------------
RISK_ORDER = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]  # rank 0..3, higher = worse
RECOMMENDATION_ORDER = ["STOP", "HOLD", "MONITOR", "PROCEED"]  # most severe first
SEVERITY_ORDER = ["NORMAL", "LOW RISK", "MEDIUM RISK", "HIGH RISK", "CRITICAL"]
SEVERITY_CUTS = [0.20, 0.40, 0.60, 0.80]  # left-closed: score >= cut
RISK_DISPLAY_ORDER = ["HEALTHY", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
RISK_DISPLAY_HEALTHY_ALIASES = ["NORMAL", "OK", "PASS", "ACCEPT", "ACCEPTABLE", "NONE", "NAN"]
LEGACY_STOP_WORD = "REJECT"  # legacy synonym of STOP

# ---------------------------------------------------------------------------
# FIXED VALUES — cleaning
# ---------------------------------------------------------------------------
NULL_SENTINELS = ["-", "na", "null", "none", "n/a", "nan", "", " "]
IMPOSSIBLE_RANGES = {
    "tapping_temp": (1200.0, 1600.0),
    "pouring_temp": (1200.0, 1600.0),
    "s_": (0.0, 0.15),
    "c_": (2.5, 4.5),
    "si_": (0.5, 5.0),
    "ce": (2.5, 5.0),
    "mg_": (0.0, 0.10),
    "mg_recovery_": (0.0, 2.0),
}
IQR_FACTOR = 3.0
MISSING_DROP_FRACTION = 0.60
TRACE_NUMERIC_FRACTION = 0.20  # below -> traceability column
NUMERIC_TYPE_FRACTION = 0.30  # at or above -> numeric column
TRACEABILITY_KEYWORDS = [
    "casting_sr", "casting sr", "pattern no", "item", "furnace category", "furnace",
    "grade", "pigging", "aa", "zone", "last heel", "alloys",
    "boring", "punching", "furnace on", "furnace off",
    "tap_time", "pouring time",
]
LEAKAGE_COLUMNS = ["sulphur", "phos", "crom", "copper", "heel_metal", "nickel", "mg"]
TARGET_CANDIDATES = ["defected", "defect", "defective", "target", "label"]

# ---------------------------------------------------------------------------
# FIXED VALUES — feature formula constants
# ---------------------------------------------------------------------------
FEATURE_CONST = {
    "ce_hypo": 4.2,
    "ce_hyper": 4.3,
    "c_si_low": 1.4,
    "c_si_high": 2.0,
    "mn_s_risk": 2.0,
    "sulfur_high": 0.025,
    "sulfur_mid": 0.015,
    "mg_rec_risk": 0.40,
    "mg_rec_severe": 0.30,
    "temp_loss_risk": 80.0,
    "temp_loss_low": 20.0,
    "pour_cold": 1300.0,
    "pour_hot": 1500.0,
    "al_oxid": 0.02,
    "pour_oxid": 1450.0,
    "shrink_ce_w": 1.5,
    "shrink_si": 2.0,
    "shrink_pour": 1420.0,
    "gas_n": 0.008,
    "gas_mg": 0.055,
    "gas_crca": 50.0,
    "fsm_low": 8.0,
    "fsm_s": 0.012,
    "heel_risk": 0.5,
    "chem_ok": 0.1,
}
# graphitisation weights: (column, weight); positive = graphitiser
GRAPHITIZATION_WEIGHTS = [("si_", 2.0), ("ce_", 5.0), ("cr_", -3.5), ("mn_", -0.3), ("mo_", -3.0)]
# ideal chemistry ranges used by the instability score
CHEMISTRY_RANGES = [("c_", 3.5, 3.8), ("si_", 2.0, 2.8), ("mn_", 0.1, 0.4), ("mg_", 0.03, 0.055)]

# ---------------------------------------------------------------------------
# FIXED VALUES — anomaly / model settings
# ---------------------------------------------------------------------------
ANOMALY_CONTAMINATION = 0.20
IFOREST_TREES = 200
IFOREST_SAMPLE = 256
LOF_NEIGHBOURS = 20
DBSCAN_EPS = 0.8
DBSCAN_MIN_PTS = 10
KMEANS_K_RANGE = (2, 8)
PCA_VARIANCE_TARGET = 0.90
SPLIT_TEST_FRACTION = 0.20
SPLIT_SEED = 42
CV_FOLDS = 5
ROLLING_WINDOW = 50
ROLLING_MIN_PERIODS = 2
TOP_DANGEROUS = 30
TOP_ANOMALIES = 25
EXPORT_SAMPLE_ROWS = 500

# ---------------------------------------------------------------------------
# FIXED VALUES — upload vocabulary
# ---------------------------------------------------------------------------
#: Cleaned upload header -> training name.
UPLOAD_COLUMN_ALIASES = {
    "carbon": "c", "carbon_pct": "c", "c_pct": "c",
    "silicon": "si", "silicon_pct": "si", "si_pct": "si",
    "sulfur": "s", "sulphur": "s", "s_pct": "s",
    "manganese": "mn_1", "mn_pct": "mn_1",
    "phosphorus": "p", "phos": "p", "p_pct": "p",
    "carbon_equivalent": "ce",
    "mg_recovery": "mg_recovery", "mg_recovery_pct": "mg_recovery", "magnesium_recovery": "mg_recovery",
    "tap_temp": "tapping_temp", "tapping_temperature": "tapping_temp",
    "pour_temp": "pouring_temp", "pouring_temperature": "pouring_temp",
    "pour_time": "pouring_time_sec", "pouring_time": "pouring_time_sec",
    "bath_sulphur": "bath_s", "bath_sulfur": "bath_s",
    "iron": "fe", "chromium": "cr", "nickel": "ni", "copper": "cu", "cobalt": "co",
    "defective": "defect", "defected": "defect", "is_defect": "defect", "quality_defect": "defect",
    "furnace_on": "furnace_on_time", "furnace_off": "furnace_off_time",
}
#: Canonical name -> names it is copied from (first present wins).
COLUMN_ALIASES = {
    "c_": ["c_", "c", "carbon", "carbon_pct", "c_pct"],
    "si_": ["si_", "si", "silicon", "si_pct"],
    "s_": ["s_", "s", "sulfur", "sulphur", "s_pct"],
    "mn_": ["mn_", "mn", "mn_1", "manganese", "mn_pct"],
    "p__": ["p__", "p_", "p", "phosphorus", "phos", "p_pct"],
    "ce": ["ce", "carbon_equivalent"],
    "mg_recovery_": ["mg_recovery_", "mg_recovery", "mg_recovery_pct", "mg_recovery_percent"],
    "mg_": ["mg_", "mg", "magnesium"],
    "tapping_temp": ["tapping_temp", "tap_temp", "tapping_temperature"],
    "pouring_temp": ["pouring_temp", "pour_temp", "pouring_temperature"],
    "defect": ["defect", "defective", "is_defect", "quality_defect"],
}
#: Feature input -> columns it is bridged from with numeric coercion.
BRIDGE_COLUMNS = {
    "c_": ["c", "carbon"],
    "si_": ["si", "silicon"],
    "s_": ["s", "sulfur", "sulphur"],
    "mn_": ["mn_1", "mn", "manganese"],
    "p__": ["p", "phosphorus", "phos"],
    "mg_recovery_": ["mg_recovery", "mg_recovery_pct"],
    "ce_": ["ce", "carbon_equivalent"],
    "n__": ["n"],
    "al__": ["al", "al_1"],
    "cr_": ["cr"],
    "mo_": ["mo"],
}
#: Template field -> headers that mean it.
TEMPLATE_SEMANTIC_GROUPS = {
    "pouring_wt": ["pouring_wt", "pouring_weight"],
    "furnace_on_time": ["furnace_on_time", "furnace_on", "furnace_on_time_min"],
    "furnace_off_time": ["furnace_off_time", "furnace_off", "furnace_off_time_min"],
    "tapping_temp": ["tapping_temp", "tapping_temperature", "tap_temp"],
    "pouring_temp": ["pouring_temp", "pouring_temperature", "pour_temp"],
    "mg_recovery": ["mg_recovery", "mg_recovery_", "mg_recovery_pct", "magnesium_recovery"],
    "defect": ["defect", "defected", "defective", "is_defect", "quality_defect"],
}

# ---------------------------------------------------------------------------
# FIXED VALUES - the example batch of upload templates
# ---------------------------------------------------------------------------
SAMPLE_FEATURE_VALUES = {
    "tapped_wt": 12.5, "pouring_wt": 12.0, "last_heel_metal": 2.0, "graphite": 15.0, "tapping_temp": 1435.0, "pouring_temp": 1370.0,
    "pouring_time_sec": 81.0, "fsm": 1.0, "ce": 4.16, "c": 3.65, "si": 1.97, "mn_1": 0.16, "p": 0.034, "s": 0.009, "mg_recovery": 0.45,
    "bath_s": 0.012, "fe": 93.5, "cu": 0.05, "co": 0.01, "cr": 0.03, "ni": 0.02, "mn": 0.16, "crca": 25.0, "defect": 0,
}
