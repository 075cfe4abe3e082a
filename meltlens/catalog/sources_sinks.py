"""Source / sink entries (S*): round trips through the shared scratch area."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import config
from ..operators import reports as RP
from ..plans.registry import register
from ..sources import io as IO
from ..sources.fixtures import HEAT_KEY, heats, heats_raw, with_fixtures
from ..sources.tables import table_path
from .sqlparts import KEY, decided_sql


@register("s1_all_string_scan", with_fixtures(
    f"select {KEY}, tapping_temp, pouring_temp, mg_recovery, furnace, defected from heats_raw", "heats_raw"))
def s1_all_string_scan(spark, sf_dir):
    path = IO.scratch_path(spark, "raw-log")
    raw = heats_raw(spark, sf_dir).drop("empty_col")
    IO.write_table(raw.select(*[F.col(c).cast("string") for c in raw.columns]), path, "csv")
    back = IO.read_all_strings(spark, path, raw.columns)
    return back.select(*[F.col(k).cast("long" if k != "l_linenumber" else "int").alias(k) for k in HEAT_KEY],
                       "tapping_temp", "pouring_temp", "mg_recovery", "furnace", "defected")


@register("s3_extension_dispatch_scan", with_fixtures("select count(*) as n_rows from lineitem", "heats"))
def s3_extension_dispatch_scan(spark, sf_dir):
    return IO.read_by_extension(spark, table_path(sf_dir, "lineitem")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("s4_first_available_source", with_fixtures("select count(*) as n_rows from lineitem", "heats"))
def s4_first_available_source(spark, sf_dir):
    df, _path = IO.first_available(spark, [os.path.join(sf_dir, "missing.parquet"),
                                           table_path(sf_dir, "lineitem")], require=["l_orderkey"])
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


@register("s6_parquet_sink_roundtrip", with_fixtures(
    f"select {KEY}, defect, cluster, defect_prob, anomaly_score from heats", "heats"))
def s6_parquet_sink_roundtrip(spark, sf_dir):
    path = IO.scratch_path(spark, "scored")
    IO.write_table(heats(spark, sf_dir).select(*HEAT_KEY, "defect", "cluster", "defect_prob", "anomaly_score"), path)
    return spark.read.parquet(path)


@register("s8_capped_export", with_fixtures(
    f"select {KEY}, anomaly_score from heats order by anomaly_score desc, {KEY} limit 500", "heats"))
def s8_capped_export(spark, sf_dir):
    path = IO.scratch_path(spark, "export")
    h = heats(spark, sf_dir).select(*HEAT_KEY, "anomaly_score")
    IO.export_capped(h, [F.desc("anomaly_score"), *HEAT_KEY], 500, path, "parquet")
    return spark.read.parquet(path)


@register("s10_sectioned_union", with_fixtures(
    "select 'by_defect' as section, cast(defect as varchar) as defect, cast(count(*) as varchar) as n, "
    "null as furnace from heats group by defect union all select 'by_furnace', null, cast(count(*) as varchar), "
    "furnace from heats group by furnace", "heats"))
def s10_sectioned_union(spark, sf_dir):
    h = heats(spark, sf_dir)
    a = h.groupBy("defect").agg(F.count(F.lit(1)).alias("n"))
    b = h.groupBy("furnace").agg(F.count(F.lit(1)).alias("n"))
    return IO.sectioned_union({"by_defect": a, "by_furnace": b}).select("section", "defect", "n", "furnace")


@register("s13_feature_schema_roundtrip", with_fixtures(
    "select 0 as ordinal, 'c_' as name, count(c_) as n_values from heats union all "
    "select 1, 'si_', count(si_) from heats union all select 2, 'feat_temp_loss', count(*) from heats", "heats"))
def s13_feature_schema_roundtrip(spark, sf_dir):
    from ..operators.features import engineer_features
    path = IO.scratch_path(spark, "feature-schema")
    IO.save_feature_schema(spark, ["c_", "si_", "feat_temp_loss"], path)
    names = IO.load_feature_schema(spark, path)
    f = engineer_features(heats(spark, sf_dir).select("c_", "si_", "tapping_temp", "pouring_temp"))
    agg = f.agg(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("name"), F.count(n).alias("n_values"))
                          for i, n in enumerate(names)]).alias("a"))
    return agg.select(F.explode("a").alias("x")).select("x.*")


@register("s15_fill_values_table", with_fixtures(
    "select median(tapping_temp) as tapping_temp, median(pouring_temp) as pouring_temp from heats", "heats"))
def s15_fill_values_table(spark, sf_dir):
    from ..plans.ordered import median_row
    path = IO.scratch_path(spark, "fill-values")
    med = median_row(heats(spark, sf_dir), ["tapping_temp", "pouring_temp"], prefix="").first().asDict()
    IO.save_fill_values(spark, med, path)
    fills = IO.load_fill_values(spark, path)
    return spark.createDataFrame([(fills["tapping_temp"], fills["pouring_temp"])], "tapping_temp double, pouring_temp double")


@register("s16_template_rows", with_fixtures(
    "select 'healthy' as template, median(c_) as c_, 1.5e-2 as s_ from heats union all "
    "select 'defective', median(c_), 3e-2 from heats", "heats"))
def s16_template_rows(spark, sf_dir):
    from ..plans.ordered import median_row
    stats = median_row(heats(spark, sf_dir), ["c_", "s_"], prefix="")
    return IO.template_rows(stats, {"healthy": {"s_": 0.015}, "defective": {"s_": 0.03}})


@register("s7_decision_guarded_export", decided_sql(
    f"select {KEY}, risk_level, recommendation, final_risk_score from final"))
def s7_decision_guarded_export(spark, sf_dir):
    from .core import decided
    path = IO.scratch_path(spark, "guarded")
    d = decided(spark, sf_dir)
    d = RP.export_frame(d.select("*", F.col("furnace"), F.col("cluster")))  # repeated columns go before the export
    IO.write_table(d.select(*HEAT_KEY, "risk_level", "recommendation", "final_risk_score"), path)
    return spark.read.parquet(path)


@register("streaming_decision_scoring", decided_sql(
    f"select {KEY}, risk_level, recommendation, final_risk_score from final"))
def streaming_decision_scoring(spark, sf_dir):
    from ..streaming.scoring import score_stream_once
    return score_stream_once(spark, sf_dir)


_TEMPLATE = ["c_", "s_", "heel", "unknown_feature", *config.SAMPLE_FEATURE_VALUES]


@register("s16_sample_template", with_fixtures(
    "select median(c_) as c_, median(s_) as s_, median(heel) as heel, 0e0 as unknown_feature, "
    + ", ".join(f"{v!r}::double as {k}" for k, v in config.SAMPLE_FEATURE_VALUES.items() if k != "defect")
    + ", unnest([0, 1]) as defect from heats", "heats"))
def s16_sample_template(spark, sf_dir):
    """The healthy and the defective example batch."""
    from ..plans.ordered import median_row
    stats = median_row(heats(spark, sf_dir), ["c_", "s_", "heel"], prefix="")
    return IO.sample_template(stats, _TEMPLATE, 0).unionByName(IO.sample_template(stats, _TEMPLATE, 1))
