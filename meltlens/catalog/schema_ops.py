"""Schema operators (H*) and streaming scoring entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import schema as H
from ..plans.registry import register
from ..sources.fixtures import HEAT_KEY, heats, heats_raw, with_fixtures
from .sqlparts import KEY

# raw-style headers as a log export would carry them (metadata only)
_RAW_HEADERS = {"tapping_temp": "Tapping Temp", "pouring_temp": "Pouring  Temp\n", "mg_recovery": "Mg Recovery %",
                "furnace": "Furnace", "empty_col": "Empty Col", "defected": "DEFECTED"}


def _non_null_report(df):
    """Per renamed column: position and non-NULL count (one aggregate over the data)."""
    cols = df.columns
    agg = df.agg(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"),
                                    F.count(F.col(f"`{c}`")).alias("n_non_null")) for i, c in enumerate(cols)]).alias("a"))
    return agg.select(F.explode("a").alias("x")).select("x.*")


def _nn_sql(pairs):
    return " union all ".join(f"select {i} as ordinal, '{n}' as column_name, count({src}) as n_non_null from heats_raw"
                              for i, (n, src) in enumerate(pairs))


def _raw_style(spark, sf_dir):
    h = heats_raw(spark, sf_dir)
    return h.select(*HEAT_KEY, *[F.col(c).alias(n) for c, n in _RAW_HEADERS.items()])


_SRC = ["tapping_temp", "pouring_temp", "mg_recovery", "furnace", "empty_col", "defected"]


@register("h1_header_clean_offline", with_fixtures(_nn_sql(list(zip(
    ["tapping_temp", "pouring_temp", "mg_recovery", "furnace", "empty_col", "defected"], _SRC))), "heats_raw"))
def h1_header_clean_offline(spark, sf_dir):
    return _non_null_report(H.rename_headers(_raw_style(spark, sf_dir).drop(*HEAT_KEY)))


@register("h2_header_clean_online", with_fixtures(_nn_sql(list(zip(
    ["tapping_temp", "pouring_temp", "mg_recovery_", "furnace", "empty_col", "defected"], _SRC))), "heats_raw"))
def h2_header_clean_online(spark, sf_dir):
    return _non_null_report(H.rename_headers(_raw_style(spark, sf_dir).drop(*HEAT_KEY), cleaner=H.clean_header_online))


@register("h3_duplicate_suffix", with_fixtures(_nn_sql([
    ("tapping_temp", "tapping_temp"), ("tapping_temp_1", "pouring_temp"), ("furnace", "furnace"),
    ("furnace_1", "furnace"), ("furnace_2", "defected")]), "heats_raw"))
def h3_duplicate_suffix(spark, sf_dir):
    h = heats_raw(spark, sf_dir)
    d = h.select(F.col("tapping_temp").alias("Tapping Temp"), F.col("pouring_temp").alias("tapping temp"),
                 F.col("furnace").alias("Furnace"), F.col("furnace").alias("FURNACE"), F.col("defected").alias("furnace"))
    return _non_null_report(H.rename_headers(d))


@register("h4_drop_duplicate_columns", with_fixtures(
    f"select {KEY}, tapping_temp, furnace from heats_raw", "heats_raw"))
def h4_drop_duplicate_columns(spark, sf_dir):
    h = heats_raw(spark, sf_dir)
    d = h.select(*HEAT_KEY, F.col("tapping_temp").alias("Tapping Temp"), F.col("pouring_temp").alias("tapping temp"),
                 F.col("furnace").alias("Furnace"))
    return H.drop_duplicate_columns(d)


@register("h5_collapse_duplicates", with_fixtures(
    f"select {KEY}, tapping_temp from heats_raw", "heats_raw"))
def h5_collapse_duplicates(spark, sf_dir):
    h = heats_raw(spark, sf_dir)
    d = h.select(*HEAT_KEY, F.col("empty_col").alias("Tapping Temp"), F.col("tapping_temp").alias("tapping temp"))
    return H.collapse_duplicate_columns(d)


@register("h6_h7_aliases", with_fixtures(
    f"select {KEY}, tapping_temp as tap_temp, pouring_temp as pour_temp, pouring_temp from heats_raw", "heats_raw"))
def h6_h7_aliases(spark, sf_dir):
    h = heats_raw(spark, sf_dir).select(*HEAT_KEY, "tapping_temp", "pouring_temp")
    r = H.apply_rename_aliases(h, {"tapping_temp": "tap_temp"})
    return H.apply_copy_aliases(r, {"pour_temp": ["pouring_temp"]}).select(*HEAT_KEY, "tap_temp", "pour_temp",
                                                                          "pouring_temp")


@register("h8_bridge_coercion", with_fixtures(
    f"""select {KEY}, case when regexp_full_match(trim(replace(mg_recovery, '%', '')), '^[0-9]+$')
        then cast(trim(replace(mg_recovery, '%', '')) as double) end as mg_recovery_ from heats_raw""", "heats_raw"))
def h8_bridge_coercion(spark, sf_dir):
    h = heats_raw(spark, sf_dir).select(*HEAT_KEY, "mg_recovery")
    return H.bridge_columns(h, {"mg_recovery_": ["mg_recovery"]}).select(*HEAT_KEY, "mg_recovery_")


@register("h9_target_promotion", with_fixtures(
    "select defect, count(*) as n from (select case when defected is null then null else cast(defected as int) end "
    "as defect from heats_raw) group by defect", "heats_raw"))
def h9_target_promotion(spark, sf_dir):
    d = H.promote_target(heats_raw(spark, sf_dir))
    return d.groupBy("defect").agg(F.count(F.lit(1)).alias("n"))


@register("h10_h11_trace_split", with_fixtures(
    "select * from (values ('furnace', 'trace'), ('mg_recovery', 'ml'), ('pouring_temp', 'ml'), "
    "('tapping_temp', 'ml')) t(column_name, role)", "heats_raw"))
def h10_h11_trace_split(spark, sf_dir):
    from ..operators.cleaning import clean_table
    _c, _t, rep = clean_table(heats_raw(spark, sf_dir), key_cols=HEAT_KEY)
    rows = [(c, "trace") for c in rep.trace_columns] + [(c, "ml") for c in rep.numeric_columns + rep.categorical_columns]
    return spark.createDataFrame(rows, "column_name string, role string")


@register("h12_numeric_selection", with_fixtures(
    f"select {KEY}, c_, si_, s_, tapping_temp, pouring_temp from heats", "heats"))
def h12_numeric_selection(spark, sf_dir):
    h = heats(spark, sf_dir).select(*HEAT_KEY, "furnace", "c_", "si_", "s_", "tapping_temp", "pouring_temp", "defect")
    return h.select(*HEAT_KEY, *H.numeric_columns(h, exclude=["defect", *HEAT_KEY]))


@register("h13_default_columns", with_fixtures(
    f"select {KEY}, 0e0 as defect_prob, 0e0 as anomaly_score, -1 as cluster, 'NORMAL' as anomaly_severity "
    "from heats_raw", "heats_raw"))
def h13_default_columns(spark, sf_dir):
    h = heats_raw(spark, sf_dir).select(*HEAT_KEY)
    return H.ensure_columns(h, {"defect_prob": 0.0, "anomaly_score": 0.0, "cluster": -1, "anomaly_severity": "NORMAL"})


@register("h16_align_training_schema", with_fixtures(
    f"select {KEY}, c_, si_, coalesce(cr_, 0e0) as cr_, 5e-2 as mo_, 1.4e3 as tapping_temp from heats", "heats"))
def h16_align_training_schema(spark, sf_dir):
    h = heats(spark, sf_dir)
    a = H.align_to_schema(h.select(*HEAT_KEY, "c_", "si_", "cr_", "furnace"),
                          [*HEAT_KEY, "c_", "si_", "cr_", "mo_", "tapping_temp"],
                          {"mo_": 0.05, "tapping_temp": 1400.0})
    return a.select(*[F.col(k).cast("long") if k != "l_linenumber" else F.col(k).cast("int") for k in HEAT_KEY],
                    "c_", "si_", "cr_", "mo_", "tapping_temp")


@register("h17_alignment_report", with_fixtures(
    "select 0 as ordinal, 'c_' as \"column\", 'present' as status, count(*) filter (where c_ is null) as n_null, "
    "count(*) filter (where abs(c_) = 'inf'::double) as n_inf from heats union all "
    "select 1, 'si_', 'present', count(*) filter (where si_ is null), count(*) filter (where abs(si_) = 'inf'::double) "
    "from heats union all select 2, 'mo_', 'median_filled', cast(0 as bigint), cast(0 as bigint)", "heats"))
def h17_alignment_report(spark, sf_dir):
    return H.alignment_report(heats(spark, sf_dir), ["c_", "si_", "mo_"])


@register("h18_column_groups", with_fixtures(
    "select 'chemistry' as column_group, round(avg(c_ + si_ + mn_ + p__ + s_ + cr_ + mg_ + n__ + al__), 9) "
    "as mean_group_sum from heats union all select 'process', round(avg(tapping_temp + pouring_temp + mg_recovery_ "
    "+ fsmaddition_mt + heel + tapped_wt_ + crca), 9) from heats", "heats"))
def h18_column_groups(spark, sf_dir):
    h = heats(spark, sf_dir)
    g = H.column_groups(h.columns)
    parts = []
    for name, cols in g.items():
        tot = F.col(cols[0])
        for c in cols[1:]:
            tot = tot + F.col(c)
        parts.append(F.struct(F.lit(name).alias("column_group"), F.round(F.avg(tot), 9).alias("mean_group_sum")))
    return h.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")


@register("h18_missing_reason", with_fixtures(
    """select 'chemistry' as label, round(avg(c_ + si_ + mn_ + p__ + s_), 9) as mean_sum, cast(null as varchar) as reason from heats
    union all select 'process', round(avg(c_ + si_ + mn_ + p__ + s_ + tapping_temp + pouring_temp + mg_recovery_ + anomaly_score + defect_prob), 9),
      null from heats
    union all select 'carbon', null, 'No carbon: missing columns ce, feat_ce_calculated.'
    union all select 'cold', null, case when count(*) = 0 then 'No cold: dataframe is empty.' end from heats where tapping_temp < 1e3""", "heats"))
def h18_missing_reason(spark, sf_dir):
    """Mean sums of the chart groups, and why charts cannot be drawn."""
    h = heats(spark, sf_dir)
    total = lambda names: F.round(F.avg(sum((F.col(c) for c in names[1:]), F.col(names[0]))), 9)
    groups = {"chemistry": H.chemistry_columns(h), "process": H.process_feature_columns(h)}
    wide = h.agg(F.array(*[F.struct(F.lit(n).alias("label"), total(c).alias("mean_sum")) for n, c in groups.items()]).alias("a"))
    means = wide.select(F.explode("a").alias("r")).select("r.*", F.lit(None).cast("string").alias("reason"))
    reasons = [("carbon", None, H.missing_reason(h, ["c_", "ce", "feat_ce_calculated"], "carbon")),
               ("cold", None, H.missing_reason(h.where("tapping_temp < 1e3"), ["c_"], "cold"))]
    return means.unionByName(spark.createDataFrame(reasons, "label string, mean_sum double, reason string"))
