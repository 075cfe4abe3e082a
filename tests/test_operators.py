"""Cleaning, ordered totals, quantiles, headers and the oracle gate on sf0.001."""

import duckdb
import pytest
from pyspark.sql import functions as F

from meltlens.functions.scalar import clamp01_scalar, sentinel_to_numeric
from meltlens.operators import schema as H
from meltlens.plans.ordered import exact_quantiles, running_totals

SF = "/root/testdata/sf0.001"


def test_header_cleaners():
    assert H.clean_header_offline("C %") == "c"
    assert H.clean_header_online("C %") == "c_"
    assert H.clean_header_offline("Pouring\nTemp") == "pouringtemp"
    assert H.suffix_duplicates(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]


def test_sentinels_and_clamp(spark):
    df = spark.createDataFrame([(" - ",), ("N/A",), ("1d",), ("nan",), ("12.5",), ("35%",)], "x string")
    got = [r[0] for r in df.select(sentinel_to_numeric(F.col("x"))).collect()]
    assert got == [None, None, None, None, 12.5, None]
    got2 = [r[0] for r in df.select(sentinel_to_numeric(F.col("x"), strip_percent=True)).collect()]
    assert got2[-1] == 35.0
    v = spark.createDataFrame([(0.4,), (40.0,), (400.0,), (None,), (float("nan"),)], "v double")
    assert [r[0] for r in v.select(clamp01_scalar(F.col("v"))).collect()] == [0.4, 0.4, 1.0, 0.0, 0.0]


def test_running_totals_hot_key_matches_window(spark):
    # one key holds most rows: totals must equal a plain window
    rows = [(0 if i % 4 else 1, i, float(i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, o int, v double")
    got = running_totals(df, ["k"], ["o"], {"cs": F.col("v")}, num_partitions=7)
    from pyspark.sql.window import Window
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("cs", F.sum("v").over(w))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_exact_quantiles_match_duckdb(spark):
    rows = [(float((i * 37) % 101), float(i % 3)) for i in range(1001)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75]).collect()}
    pdf = df.toPandas()
    for c in ["a", "b"]:
        for p in [0.25, 0.5, 0.75]:
            exp = duckdb.sql(f"select quantile_cont({c}, {p}) from pdf").fetchall()[0][0]
            assert got[(c, p)] == pytest.approx(exp)


def test_oracle_gate_on_core_queries(spark):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duckdb.connect()
    for t in ["lineitem", "events", "embeddings"]:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name in ["d11_decision_summary", "f16_feature_table", "c21_clean_heats_raw", "m19_classification_metrics",
                 "w1_rolling_defect_trend", "a23_defect_drivers"]:
        df = qs[name](spark, SF)
        got = sorted(tuple(str(x) for x in r) for r in df.select(*sorted(df.columns)).collect())
        res = con.execute(sql[name])
        cols = [d[0] for d in res.description]
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        exp = sorted(tuple(str(r[i]) for i in order) for r in res.fetchall())
        assert len(got) == len(exp), name
        assert got == exp, name


def test_entry_smoke(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert out.columns == ["risk_level", "recommendation", "n_batches"]
    assert sum(r["n_batches"] for r in out.collect()) > 0


def test_rolling_mean_hot_key_with_gaps_matches_pandas(spark):
    import pandas as pd
    from meltlens.operators.windows import rolling_mean
    rows = []
    for i in range(2500):
        k = 0 if i % 5 else 1 + (i % 3)            # key 0 holds 80 % of rows
        v = None if (i % 7 == 0 and i % 2 == 0) else float((i * 13) % 11)
        rows.append((k, i, v))
    df = spark.createDataFrame(rows, "k int, seq int, v double")
    got = {(r["k"], r["seq"]): r["rolling_v"] for r in rolling_mean(df, ["k"], "seq", "v", 50, 2).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "seq", "v"]).sort_values(["k", "seq"])
    exp = {}
    for k, g in pdf.groupby("k"):
        r = g["v"].rolling(50, min_periods=2).mean().bfill().ffill()
        exp.update({(k, s): x for s, x in zip(g["seq"], r)})
    assert got.keys() == exp.keys()
    for key, x in exp.items():
        assert got[key] == pytest.approx(x, rel=1e-9, abs=1e-12), key


def test_exact_auc_with_ties_matches_pair_count(spark):
    from meltlens.operators.evaluation import roc_auc
    rows = [(int(i % 3 == 0), float((i * 7) % 13) / 13.0) for i in range(400)]
    df = spark.createDataFrame(rows, "y int, p double")
    got = roc_auc(df).first()["roc_auc"]
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    wins = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    assert got == pytest.approx(wins / (len(pos) * len(neg)), rel=1e-12)
