"""N-gram Jaccard join against all pairs."""

import random

import numpy as np
import pyarrow as pa
from awkward_data import brute_components, sentence, shingles

from meltlens.llm import jaccard_join as jj

KEY = lambda r: tuple(map(str, r))


def check(df, rows):
    got = jj.join_documents(df).collect()
    want = [(i, n, least if n else i) for (i, _), (n, least) in zip(rows, brute_components(rows))]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=KEY) == sorted(want, key=KEY)


def test_awkward_rows(docs, rows, empty):
    check(docs, rows)
    assert jj.join_documents(empty).count() == 0


def test_one_of_each_group_stays(docs, rows, empty):
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {least for n, least in brute_components(rows) if n}
    wordless = [i for i, t in rows if not shingles(t)]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [*groups, *wordless]))
    assert jj.keep_one(empty).count() == 0


def test_families_around_the_threshold(spark):
    """Chains, hubless groups and a passage on most rows; similarities just below and above 0.75."""
    rng = random.Random(11)
    rows, passage = [], sentence(rng, 25)
    for family in range(6):
        base = sentence(rng, rng.choice([20, 60, 150])).split()
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, max(2, len(copy) // 25))):
                at = rng.randrange(len(copy))
                copy[at:at + 1] = rng.choice([[], [sentence(rng, 1)], [copy[at], sentence(rng, 1)]])
            rows.append((len(rows), " ".join(copy) + (" " + passage if rng.random() < 0.6 else "")))
    walk = sentence(rng, 100).split()
    for _ in range(25):  # each links with the next ones only
        walk = walk[3:] + sentence(rng, 3).split()
        rows.append((len(rows), " ".join(walk)))
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_blocks_count_shared_prefix_tokens(monkeypatch):
    """Whatever the cut into blocks and ranges, no class counts fewer shared tokens than it has."""
    rng = np.random.default_rng(3)
    pool = rng.integers(-2**62, 2**62, 400)
    lists = [rng.choice(pool, rng.integers(1, 60), replace=False) if k % 3 else rng.integers(-2**62, 2**62, 30) for k in range(200)]
    lists += lists[:20]
    ids = [int(hash(tuple(x.tolist()))) for x in lists]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))], ["c", "w"])
    sets = dict(zip(ids, jj.shingle_sets(batch.column("w"))))
    heads = {c: set(s[:len(s) - jj.least_overlap(len(s)) + jj.ell(len(s))].tolist()) for c, s in sets.items()}
    want = {c: sum(any(t in heads[d] for d in heads if d != c) for t in h) for c, h in heads.items()}
    for size in (40, 10**6):
        monkeypatch.setattr(jj, "BLOCK_TOKENS", size)
        blocks = pa.Table.from_batches(jj.send_prefixes(3)(iter([batch, batch]))).to_pandas()
        counted = {}
        for _, block in blocks.groupby("range"):
            for row in jj.count_shared(4)(block).itertuples():
                columns = (np.frombuffer(x, kind) for x, kind in ((row.classes, "i8"), (row.sizes, "i4"), (row.counts, "i4")))
                for c, n, k in zip(*(x.tolist() for x in columns)):
                    assert n == len(sets[c])
                    counted[c] = counted.get(c, 0) + k
        assert all(counted.get(c, 0) >= k for c, k in want.items())
        if size > 1000:
            assert {c for c, k in counted.items() if k} == {c for c, k in want.items() if k}


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (200, 200)]
    got = jj.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.c, r.root) for r in got} == {(k, 0) for k in range(61)} | {(100, 100), (101, 100)}
    assert jj.components(spark.createDataFrame([], "a long, b long")).count() == 0
