"""The pipeline's stages against brute force on a small table, and the registered queries."""

import duckdb
import numpy as np
import pytest
from awkward_data import brute_components, brute_hits, brute_mask, brute_quality, shingles
from test_tokens import ids_of

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def expected():
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    good = [(i, t) for i, t in docs if brute_quality(t)[-1]]
    single = [(i, t) for (i, t), (n, least) in zip(good, brute_components(good)) if not n or least == i]
    clean = []
    for i, t in single:
        n, hit, _ = brute_hits(t, items)
        if not hit or 20 * len(hit) < n:
            clean.append((i, t))
    return [sorted(good), sorted(single), sorted(clean), sorted((i, brute_mask(t)) for i, t in clean)]


def test_stages(spark, expected):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for (name, stage), want in zip(cp.STAGES, expected):
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        rows = docs.select("doc_id", "text", "n_chars").collect()
        assert sorted((r.doc_id, r.text) for r in rows) == want, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)


def test_run(spark, expected):
    got = cp.run(spark, SF).collect()
    want = set()
    for i, t in expected[-1]:
        ids = ids_of("word_bpe_49k.json", t, 1)
        want |= {(i, k // 4096, k, len(ids[k:k + 4096])) for k in range(0, len(ids), 4096)}
    assert {(r.doc_id, r.piece, r.start, r.length) for r in got} == want and len(got) == len(want)
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= np.ceil(total / 4096) + 1


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_entry_lists_every_operator():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert not shingles(None)


@pytest.mark.parametrize("name", ["op1_url_filter", "op3_quality_rules", "op6_decontamination", "op7_secret_scan", "op8_jaccard_join"])
def test_sql_twins(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want.fetchall()))
