"""NULL keys, NaN values, large keys, dirty text and clashing names give right results."""

import math
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meltlens.operators import analytics as AN
from meltlens.operators import decisions as D
from meltlens.operators import evaluation as EV
from meltlens.operators import neighbours as NB
from meltlens.operators import rules as R
from meltlens.operators import schema as H
from meltlens.operators.cleaning import clean_table
from meltlens.operators.lof import lof_scores
from meltlens.operators.windows import rolling_mean
from meltlens.plans.ordered import exact_quantiles, running_totals


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from meltlens.session import ship_package

    ship_package(spark)


def keyed(spark):
    rows = [(None if i % 3 else f"k{i % 5}", i, float(i % 7)) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, i long, v double").repartition(5), pd.DataFrame(rows, columns=["k", "i", "v"])


def test_running_totals_of_a_null_key(spark):
    df, pdf = keyed(spark)
    got = running_totals(df, ["k"], ["i"], {"t": F.col("v")}, 7).toPandas().set_index("i")["t"]
    want = pdf.groupby("k", dropna=False)["v"].cumsum()
    assert len(got) == len(pdf) and np.allclose(got.sort_index(), want)


def test_rolling_mean_of_a_null_key_and_nan(spark):
    df, pdf = keyed(spark)
    df = df.withColumn("v", F.when(F.col("i") == 30, F.lit(float("nan"))).otherwise(F.col("v")))
    got = rolling_mean(df, ["k"], "i", "v", 50, 2, "m").toPandas().set_index("i")["m"].sort_index()
    pdf.loc[30, "v"] = np.nan
    want = pdf.groupby("k", dropna=False)["v"].transform(lambda s: s.rolling(50, min_periods=2).mean().bfill().ffill())
    assert np.allclose(got, want)


def test_quantiles_of_a_null_group(spark):
    df, pdf = keyed(spark)
    got = {(r.k, r.prob): r.value for r in exact_quantiles(df, ["v"], [0.25, 0.5], by="k").collect()}
    want = pdf.groupby("k", dropna=False)["v"].quantile([0.25, 0.5])
    assert len(got) == len(want) and all(got[None if isinstance(k, float) else k, q] == v for (k, q), v in want.items())
    assert AN.five_number_summary(df, "v", "k").count() == 6


def test_split_of_large_and_null_classes(spark):
    df = spark.createDataFrame([(6_000_000_000 + i, -(2**62) + i, None if i % 4 else 1) for i in range(400)], "a long, b long, y int")
    got = EV.stratified_split(df, "y", ["a", "b"]).groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in got} == {(None, "test"): 60, (None, "train"): 240, (1, "test"): 20, (1, "train"): 80}


def test_auc_of_counts_beyond_a_long(spark, monkeypatch):
    scores = spark.createDataFrame([(0.1, 0, 4_000_000_000), (0.9, 4_000_000_000, 0)], "score double, pos long, neg long")
    monkeypatch.setattr(EV, "score_table", lambda *a: scores)
    assert EV.roc_auc(scores).first()["roc_auc"] == 1.0


def test_dirty_clusters_and_measures(spark):
    df = spark.createDataFrame([("2.0", "n/a", 0.5), ("abc", "3.4", 0.5), (None, None, None), ("2", "3.4", 0.9)],
                               "cluster string, c_ string, defect_prob double")
    got = D.unified_decisions(df).collect()
    assert len(got) == 4 and all(r.risk_level for r in got)
    stats = {r.cluster: r.batch_count for r in D.cluster_stats(df).collect()}
    assert stats == {2: 2}
    assert R.interpret(df.withColumn("anomaly_score", F.lit(0.1))).count() == 4


def test_header_suffixes_are_free_names():
    assert H.suffix_duplicates(["a", "a", "a_1"]) == ["a", "a_2", "a_1"]
    assert H.suffix_duplicates(["k", "b", "b"], reserved=["k"]) == ["k_1", "b", "b_1"]
    assert H.clean_header_offline(" Mg  Recovery (%)\n") == "mg_recovery"
    assert H.clean_header_online("Tapping\tTemp. ") == "tapping_temp" and H.clean_header_online("C %") == "c_"


def test_key_columns_keep_their_names(spark):
    rows = [(i, f"{i % 4}.5", str(i % 2)) for i in range(30)]
    clean, _, _ = clean_table(spark.createDataFrame(rows, ["Batch Key", "C %", "DEFECTED"]), key_cols=["Batch Key"])
    assert "Batch Key" in clean.columns and clean.count() > 0


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=(490, 3)), rng.normal(size=(10, 3)) * 0.2 + 9]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double"), x


def test_isolation_forest(cloud):
    df, _ = cloud
    nodes, m = NB.fit_isolation_forest(df, ["a", "b", "c"])
    assert m == 256 and nodes.groupby("tree")["n_sample"].first().eq(256).all() and nodes["tree"].nunique() == 200
    scored = NB.scaled_flag(NB.score_isolation_forest(df, ["a", "b", "c"], nodes, m), "if_score", "n", "flag").toPandas()
    assert set(scored.nlargest(10, "if_score")["id"]) == set(range(490, 500))
    assert abs(scored["flag"].mean() - 0.2) <= 1 / 500 + 1e-9 and scored["n"].between(0, 1).all()
    assert scored["if_score"].nunique() > 400
    few, n = NB.fit_isolation_forest(df.limit(3).withColumn("a", F.lit(None).cast("double")), ["a", "b"])
    assert n == 3 and len(few)


@pytest.mark.parametrize("key", ["id", None])
def test_isolation_forest_pool_holds_copies_in_proportion(spark, key):
    """A third of the rows are one point; the trees' pool is a tenth of the table."""
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 50.0).otherwise(F.rand(3)).alias("a"))
    for seed in (1, 2, 3):
        nodes, m = NB.fit_isolation_forest(df, ["a"], n_trees=10, sample_size=60, seed=seed, key=key)
        copies = [g.loc[g["feat"] < 0, "size"].max() for _, g in nodes.groupby("tree")]
        assert m == 60 and 0.25 < np.mean(copies) / 60 < 0.42


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    kd = np.sort(d, axis=1)[:, k - 1]
    near = [np.flatnonzero(row <= cut) for row, cut in zip(d, kd)]
    lrd = np.array([1 / (np.maximum(kd[o], d[i, o]).mean() + 1e-10) for i, o in enumerate(near)])
    return np.array([lrd[o].mean() / lrd[i] for i, o in enumerate(near)])


@pytest.mark.parametrize("leaf", [40, 2000])
def test_lof_equals_all_pairs(spark, cloud, leaf):
    df, x = cloud
    x = np.r_[x, np.repeat(x[:2], 30, axis=0)].round(2)  # ties and hot duplicates
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    got = lof_scores(df, ["a", "b", "c"], 20, leaf_points=leaf).toPandas().sort_values("id")["lof_score"]
    assert np.allclose(got, brute_lof(x, 20), rtol=1e-9)


def test_lof_of_few_rows(spark):
    df = spark.createDataFrame([(1, 0.0)], "id long, a double")
    assert [r.lof_score for r in lof_scores(df, ["a"]).collect()] == [1.0]
    three = spark.createDataFrame([(1, 0.0), (2, None), (3, math.nan)], "id long, a double")
    assert all(r.lof_score == pytest.approx(1) for r in lof_scores(three, ["a"]).collect())


def test_upload_chain(spark):
    """Raw headers, percent signs, duplicate and empty columns, repeated and blank rows; missing signals are scored."""
    from meltlens.operators.upload import Artefacts, SchemaMismatch, Scorer, prepare_upload

    rows = [("b1", "3.6", "1435", "45%", None, "x", "1"), ("b1", "3.6", "1435", "45%", None, "x", "1"), ("b2", " - ", "1400", "n/a", None, "y", None),
            ("b3", "3.4", "", "30%", None, "z", "0"), (None, None, None, None, None, None, None)]
    raw = spark.createDataFrame(rows, "`Heat No` string, `Carbon` string, `Tap Temp` string, `MG Recovery %` string, `Empty` string, "
                                      "`Remarks` string, `DEFECTED` string").withColumn("carbon ", F.lit(None).cast("string"))
    out = {r["heat_no"]: r for r in prepare_upload(raw).collect()}
    assert set(out) == {"b1", "b2", "b3"} and "empty" not in prepare_upload(raw).columns
    assert out["b2"].c_ == 3.5 and out["b3"].tapping_temp == 1417.5 and out["b1"].mg_recovery_ == 45.0
    assert [out[b].defect for b in ("b1", "b2", "b3")] == [1, 0, 0] and all(r.risk_level for r in out.values())
    half = Scorer(["c_", "unknown"], {"unknown": 2.0}, lambda df: df.withColumn("defect_prob", F.col("c_") / (F.col("unknown") * 4)))
    scored = {r["heat_no"]: r.defect_prob for r in prepare_upload(raw, Artefacts(probability=half)).collect()}
    assert scored["b1"] == pytest.approx(0.45)
    with pytest.raises(SchemaMismatch, match="unknown"):
        prepare_upload(raw, Artefacts(probability=Scorer(["unknown"], {}, lambda df: df)))
    given = raw.withColumn("Defect Prob", F.lit("80"))
    assert {r.defect_prob for r in prepare_upload(given, Artefacts(probability=half)).collect()} == {0.8}


def test_template_report_names_the_upload(spark):
    got = H.template_report(spark, ["Tap Temp", "Mg Recovery %", "Notes"], ["tapping_temp", "mg_recovery", "si"]).collect()
    assert {tuple(r) for r in got} == {("Tap Temp", "matched"), ("Mg Recovery %", "matched"), ("si", "missing"), ("Notes", "extra")}


def brute_dbscan(x, eps, min_points):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= min_points
    label = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        new = np.array([min(label[near[i] & core], default=-1) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    return label, core


@pytest.mark.parametrize("leaf", [30, 2000])
def test_dbscan_equals_all_pairs(spark, cloud, leaf):
    from meltlens.operators.dbscan import dbscan

    _, x = cloud
    x = np.r_[x, np.repeat(x[:3], 20, axis=0)].round(2)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    got = dbscan(df, ["a", "b", "c"], "id", 0.55, 10, leaf_points=leaf).toPandas().sort_values("id")
    label, core = brute_dbscan(x, 0.55, 10)
    assert got["cluster"].tolist() == label.tolist() and got["is_core"].tolist() == core.tolist()
    assert len(set(label)) > 2 and (label == -1).any()
    assert dbscan(df.limit(0), ["a"], "id", 0.5, 3).count() == 0


def test_cluster_needs_a_shared_checkpoint_folder(spark):
    from meltlens.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_report_stages_compile(tmp_path):
    """No generated stage of the report queries is too large for the compiler."""
    code = ("from meltlens.session import get_session\nimport __spark_entry__ as e\nspark = get_session('local[2]', 2)\n"
            "spark.sparkContext.setLogLevel('WARN')\n"
            "for q in ('d6_enriched_table', 'd7_qa_report_lines', 'd8_report_consistency', 'r10_rule_findings'):\n"
            "    e.queries()[q](spark, '/root/testdata/sf0.001').write.format('noop').mode('overwrite').save()\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "64 KB" not in done.stderr and "failed to compile" not in done.stderr.lower()


def test_lof_gathers_no_python_group_for_each_point(spark, monkeypatch):
    """Python groups are leaves; the neighbours of a point are merged by a window."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    from meltlens.operators.lof import lof_scores

    made, apply = [], PandasGroupedOpsMixin.applyInPandas
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", lambda self, fn, schema: made.append(schema) or apply(self, fn, schema))
    x = np.round(np.random.default_rng(5).normal(size=(300, 2)), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    assert lof_scores(df, ["a", "b"], k=5, leaf_points=30).count() == 300
    assert made and not [s for s in made if "other" in str(s)]


def test_dbscan_measures_a_linked_group_once(monkeypatch):
    """Core points of one group stop asking a leaf whose groups they all met; distances at eps are decided exactly."""
    from meltlens.operators import dbscan as DB

    rng, measured, within = np.random.default_rng(3), [], DB.within
    x, held = rng.normal(size=(5000, 3)) * 0.1, rng.normal(size=(400, 3)) * 0.1
    monkeypatch.setattr(DB, "within", lambda a, b, eps: measured.append(len(a)) or within(a, b, eps))
    assert DB.near_groups(x, held, np.repeat([7, 9], 200), 0.5, np.full(5000, 4)).tolist() == [[4, 7], [4, 9]]
    assert sum(measured) == DB.BLOCK
    grid = np.stack(np.meshgrid(*[np.arange(6) * 0.1] * 3), axis=-1).reshape(-1, 3)
    for shift in (0.0, 1e3, 1e200):
        assert (within(grid + shift, grid + shift, 0.1) == (DB.distances(grid + shift, grid + shift) <= 0.1)).all()
    own, row = rng.integers(0, 30, 900), rng.normal(size=(900, 2)) * 3
    near = DB.distances(row[:600], row[600:]) <= 0.3
    pairs = sorted({(own[i], own[600 + j]) for i, j in zip(*np.nonzero(near))})
    assert DB.near_groups(row[:600], row[600:], own[600:], 0.3, own[:600]).tolist() == [list(p) for p in pairs]


def test_queries_bound_the_generated_methods(spark):
    """Any session runs the queries with methods that the JIT compiles; a limit set by the user stays."""
    import __spark_entry__ as e

    key, query = "spark.sql.codegen.hugeMethodLimit", e.queries()["d6_enriched_table"]
    before = spark.conf.get(key)
    try:
        for given, expected in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(key, given)
            query(spark, "/root/testdata/sf0.001")
            assert spark.conf.get(key) == expected
    finally:
        spark.conf.set(key, before)


def test_forest_and_anomaly_job_see_every_dimension(spark, tmp_path):
    """A row whose large values cancel in any sum over neighbouring dimensions is the outlier."""
    from meltlens.catalog import neighbours as CN

    x = np.random.default_rng(7).normal(size=(300, 64))
    x[0] = np.tile([9.0, -9.0], 32)
    spark.createDataFrame([(i, list(map(float, r)), int(i == 0)) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int") \
        .write.parquet(str(tmp_path / "embeddings.parquet"))
    top = CN.m13_isolation_forest(spark, str(tmp_path)).orderBy(F.desc("if_score")).first()
    assert top.vec_id == 0 and top.if_flag == 1
    job = CN.anomaly_frame(spark, str(tmp_path)).toPandas().set_index("vec_id")
    assert len(job) == 300 and job["if_norm"].idxmax() == 0 and job.loc[0, "anomaly_flag"] == 1
