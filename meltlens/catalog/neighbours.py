"""Neighbour / anomaly model entries (M11-M15) over ``points5``, ``points3`` and ``heats``."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..operators import models as MD
from ..operators import neighbours as NB
from ..plans.registry import register
from ..session import cut_lineage
from ..operators.clustering import sampled_silhouettes
from ..operators.dbscan import dbscan
from ..operators.lof import lof_scores
from ..sources.fixtures import EMBEDDING_DIMS, embedding_dims, heats, points3, points5, with_fixtures

_X = ["x1", "x2", "x3", "x4", "x5"]
_SQD = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _X)


@register("m11_silhouette_sq_euclidean", with_fixtures(
    f"""select ab.ca as label, round(avg(case when sz.n <= 1 or ab.b is null then 0e0
          else (ab.b - ab.a) / greatest(ab.a, ab.b) end), 6) as silhouette, count(*) as n
        from (select vec_id, ca, max(case when ca = cb then m end) as a, min(case when ca <> cb then m end) as b
              from (select a.vec_id, a.label as ca, b.label as cb, avg({_SQD}) as m
                    from points5 a join points5 b on a.vec_id <> b.vec_id group by 1, 2, 3) per
              group by 1, 2) ab join (select label, count(*) as n from points5 group by label) sz on ab.ca = sz.label
        group by ab.ca""", "points5"))
def m11_silhouette_sq_euclidean(spark, sf_dir):
    s = NB.silhouette_sq(points5(spark, sf_dir), _X, "label")
    return s.select("label", F.round("silhouette", 6).alias("silhouette"), "n")


@register("m11_silhouette", with_fixtures(
    f"""select round(avg(case when sz.n <= 1 then 0e0 else (ab.b - ab.a) / greatest(ab.a, ab.b) end), 6) as silhouette
        from (select vec_id, ca, max(case when ca = cb then m end) as a, min(case when ca <> cb then m end) as b
              from (select a.vec_id, a.label as ca, b.label as cb, avg(sqrt({_SQD})) as m
                    from points5 a join points5 b on a.vec_id <> b.vec_id group by 1, 2, 3) per
              group by 1, 2) ab join (select label, count(*) as n from points5 group by label) sz on ab.ca = sz.label""", "points5"))
def m11_silhouette(spark, sf_dir):
    """Mean Euclidean silhouette of a sample of 2,000 points held against all rows (here: of all points)."""
    p = points5(spark, sf_dir).select("vec_id", "label", array_to_vector(F.array(*_X)).alias("v"))
    found = sampled_silhouettes(p, "v", ["label"], "vec_id")["label"]
    return spark.createDataFrame([(None if found is None else round(found, 6),)], "silhouette double")


@register("m13_isolation_forest")
def m13_isolation_forest(spark, sf_dir):
    p = embedding_dims(spark, sf_dir)
    nodes, m = NB.fit_isolation_forest(p, EMBEDDING_DIMS, key="vec_id")
    scored = NB.score_isolation_forest(p, EMBEDDING_DIMS, nodes, m).select("vec_id", "if_score")
    return NB.scaled_flag(scored, "if_score", "if_norm", "if_flag").select("vec_id", "if_score", "if_norm", "if_flag")


@register("m15_ensemble_severity", with_fixtures(
    """select case when s >= 8e-1 then 'CRITICAL' when s >= 6e-1 then 'HIGH RISK' when s >= 4e-1 then 'MEDIUM RISK'
         when s >= 2e-1 then 'LOW RISK' else 'NORMAL' end as anomaly_severity,
         case when s >= 8e-1 then 4 when s >= 6e-1 then 3 when s >= 4e-1 then 2 when s >= 2e-1 then 1 else 0 end
           as severity_int, count(*) as n
       from (select 5e-1 * anomaly_score + 5e-1 * defect_prob as s from heats) group by 1, 2""", "heats"))
def m15_ensemble_severity(spark, sf_dir):
    e = NB.ensemble(heats(spark, sf_dir), "anomaly_score", "defect_prob")
    return e.groupBy("anomaly_severity", "severity_int").agg(F.count(F.lit(1)).alias("n"))


_B = ["b1", "b2", "b3"]
_D3 = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in _B)


@register("m14_lof_scores", with_fixtures(
    """select e.vec_id, round(avg(t.lrd) / any_value(o.lrd), 6) as lof_score
       from near e join dens t on t.vec_id = e.other join dens o on o.vec_id = e.vec_id group by e.vec_id""",
    "points3", ctes={
        "dist": f"""select p.vec_id, q.vec_id as other, sqrt({_D3}) as d,
                      row_number() over (partition by p.vec_id order by {_D3}) as rn
                    from points3 p join points3 q on p.vec_id <> q.vec_id""",
        "kd": "select vec_id, max(d) as kd from dist where rn <= 20 group by vec_id",
        "near": "select dist.vec_id, other, d from dist join kd on kd.vec_id = dist.vec_id where d <= kd",
        "dens": """select n.vec_id, 1e0 / (avg(greatest(k.kd, n.d)) + 1e-10) as lrd
                   from near n join kd k on k.vec_id = n.other group by n.vec_id"""}))
def m14_lof_scores(spark, sf_dir):
    s = lof_scores(points3(spark, sf_dir), _B)
    return s.select("vec_id", F.round("lof_score", 6).alias("lof_score"))


_EPS, _MIN_POINTS = 0.35, 10


@register("m12_dbscan", with_fixtures(
    """select p.vec_id, coalesce(min(l.label), -1) as cluster, bool_or(c.vec_id is not null) as is_core
       from points3 p left join core c on c.vec_id = p.vec_id
       left join near n on n.vec_id = p.vec_id left join label l on l.vec_id = n.other
       group by p.vec_id""",
    "points3", ctes={
        "near": f"select p.vec_id, q.vec_id as other from points3 p, points3 q where sqrt({_D3}) <= {_EPS}e0",
        "core": f"select vec_id from near group by vec_id having count(*) >= {_MIN_POINTS}",
        "label": """select vec_id, min(reached) as label from (
            with recursive r(vec_id, reached) as (
              select vec_id, vec_id from core
              union select r.vec_id, n.other from r join near n on n.vec_id = r.reached join core c on c.vec_id = n.other)
            select * from r) group by vec_id"""}))
def m12_dbscan(spark, sf_dir):
    return dbscan(points3(spark, sf_dir), _B, "vec_id", _EPS, _MIN_POINTS).select("vec_id", "cluster", "is_core")


#: Leading principal components that neighbours are searched in.
_PCS = ["pc1", "pc2", "pc3", "pc4", "pc5"]


def leading_components(df):
    """``df`` with M9's leading components, fitted on all rows, and the share of variance that they keep."""
    whole = df.withColumns(dict(zip(EMBEDDING_DIMS, NB.clean_features(df, EMBEDDING_DIMS))))
    base, pca, explained, _k = MD.pca_fit(whole, EMBEDDING_DIMS, 1.0)
    pcs = vector_to_array("pcs")
    out = pca.transform(base.transform(whole)).select(*df.columns, *[pcs[i].alias(c) for i, c in enumerate(_PCS)])
    return out, sum(explained[:len(_PCS)])


def anomaly_frame(spark, sf_dir):
    """Both detectors' normalised scores and flags, the ensemble score, OR flag and severity; the forest on all
    dimensions, the outlier factor on the leading components."""
    p, _kept = leading_components(embedding_dims(spark, sf_dir))
    nodes, m = NB.fit_isolation_forest(p, EMBEDDING_DIMS, key="vec_id")
    forest = NB.score_isolation_forest(p, EMBEDDING_DIMS, nodes, m).select("vec_id", "label", "if_score", *_PCS)
    scored = cut_lineage(lof_scores(forest, _PCS))
    flagged = NB.scaled_flag(NB.scaled_flag(scored, "if_score", "if_norm", "if_flag"), "lof_score", "lof_norm", "lof_flag")
    return NB.ensemble(flagged, "if_norm", "lof_norm", flags=["if_flag", "lof_flag"])


@register("m31_anomaly_job")
def m31_anomaly_job(spark, sf_dir):
    """Summary of the job: rows by label, severity and flag, with the mean ensemble score."""
    e = anomaly_frame(spark, sf_dir)
    return e.groupBy("label", "anomaly_severity", "severity_int", "anomaly_flag").agg(
        F.count(F.lit(1)).alias("n"), F.avg("anomaly_score").alias("mean_score"))
