"""Merkle manifest, fill-in-the-middle and source mixing against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from awkward_data import WORD
from pyspark.sql import functions as F

from meltlens.llm import fill_in_middle as fm
from meltlens.llm import merkle_manifest as mm
from meltlens.llm import source_mixing as sm


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def sourced(spark, docs, rows):
    """The awkward rows with a source that holds most rows, small ones, a null one and an empty name."""
    kinds = F.array(*[F.lit(x) for x in ("b", "é", "", "a")], F.lit(None).cast("string"), F.lit("one"))
    pick = F.when(F.col("doc_id") == 2, 5).when(F.col("doc_id") % 8 < 5, F.col("doc_id") % 8).otherwise(0)
    df = docs.withColumn("source", F.element_at(kinds, (F.coalesce(pick, F.lit(0)) + 1).cast("int")))
    return df.withColumn("n_chars", F.when(F.col("doc_id") == 3, None).otherwise(F.col("n_chars"))).cache()


def brute_leaf(row, text):
    out = ""
    for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(out)


def brute_tree(leaves):
    """(root, per leaf: list of (left, right) siblings)"""
    nodes, paths, where = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        for i, at in enumerate(where):
            first = at // 3 * 3
            paths[i].append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + 3])))
            where[i] = at // 3
        nodes = [H("".join(nodes[k:k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        doc, text = r["doc_id"], r["text"]
        even = doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0
        bad = text.replace("\n", "") if even and text is not None else text
        groups[r["source"]].append((doc, brute_leaf(r, text), brute_leaf(r, bad)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = brute_tree([leaf for _, leaf, _ in groups[s]])
    root, uppers = brute_tree([trees[s][0] for s in order])
    out = []
    for s, upper in zip(order, uppers):
        for (doc, leaf, other), path in zip(groups[s], trees[s][1]):
            h = other
            for left, right in path + upper:
                h = H(left + h + right)
            out.append((doc, leaf, trees[s][0], root, H("".join(a + b for a, b in path + upper)), h, h == root))
    return out


def without_line_feeds():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


@pytest.mark.parametrize("levels", [2, 6])
def test_manifest(sourced, levels):
    got = mm.merkle_manifest(sourced, tampered={"text": without_line_feeds()}, levels=levels, with_proofs=True).collect()
    want = brute_manifest([r.asDict() for r in sourced.collect()])
    assert sorted(map(str, [tuple(r)[:7] for r in got])) == sorted(map(str, want))
    assert {r.verified for r in got} == {True, False}
    for r in got:
        assert (mm.fold(r.leaf, [(s.left, s.right) for s in r.proof]) == r.root)
        assert H("".join(s.left + s.right for s in r.proof)) == r.proof_sha256


def test_butterfly_of_ragged_trees(spark):
    sizes = [1, 2, 3, 4, 27, 28, 82, 100]
    rows = [(i, n) for n in sizes for i in range(n)]
    got = mm.merkle_manifest(spark.createDataFrame(rows, "doc_id long, source long"), ["doc_id", "source"], levels=1, with_proofs=True).collect()
    leaf = lambda i, n: H(f"{len(str(i))}:{i}{len(str(n))}:{n}")
    trees = {str(n): brute_tree([leaf(i, n) for i in range(n)]) for n in sizes}
    root, uppers = brute_tree([trees[n][0] for n in sorted(trees)])
    above = dict(zip(sorted(trees), uppers))
    want = {leaf(i, n): (i, trees[str(n)][0], root, True, trees[str(n)][1][i] + above[str(n)]) for i, n in rows}
    assert {r.leaf: (r.doc_id, r.subroot, r.root, r.verified, [(s.left, s.right) for s in r.proof]) for r in got} == want


def test_manifest_of_many_sources(spark, monkeypatch):
    """More groups than a broadcast lookup may have rows."""
    from meltlens.llm import common

    monkeypatch.setattr(common, "MAX_LOOKUP_ROWS", 5)
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 17).alias("source"))
    got = mm.merkle_manifest(df, ["doc_id", "source"], levels=1)
    assert got.count() == 60 and got.where("verified").count() == 60 and got.select("root").distinct().count() == 1


def test_manifest_of_nothing(empty):
    assert mm.merkle_manifest(empty).collect() == []


def brute_cut(doc, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), H(f"1:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, docs, rows, empty):
    rng = random.Random(3)
    signs = ["a", "Zed", " ", "\n", "<", ">", "<P>", "<S", "M>", "é", "語", "😀", "́", "[", "@", "`", "{", "\x00", "1"]
    fuzz = [(10_000 + i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))) for i in range(800)]
    more = spark.createDataFrame(fuzz, "doc_id long, text string")
    got = fm.fill_in_middle(docs.select("doc_id", "text").unionByName(more))
    got = got.withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *brute_cut(i, t), t or "") for i, t in rows + fuzz]
    assert Counter(map(tuple, got)) == Counter(want)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fm.fill_in_middle(empty).count() == 0
    assert fm.fill_in_middle(docs).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 256, 257, 5000])
def test_skip_list_offsets(n):
    widths = np.random.default_rng(n).integers(1, 9, n)
    units = fm.SkipList(widths)
    assert [units.offset(r) for r in range(n + 1)] == [0, *np.cumsum(widths).tolist()]
    assert all(len(lane[0]) <= -(-n // 16**k) for k, lane in enumerate(units.lanes))


def brute_targets(words):
    """Shares by weight, capped and reshared until none is above its cap."""
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(words.values()), set()
    while True:
        left, open_ = total - sum(3 * words[s] for s in capped), [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * words[s]}
        if not over:
            return {s: 3.0 * words[s] if s in capped else share[s] for s in order}, capped
        capped |= over


def brute_seats(votes, seats):
    """Highest quotients, one seat after the other."""
    heap = [(0.5 / v, p, 0) for p, v in votes.items() if v > 0]
    heapq.heapify(heap)
    quota = dict.fromkeys(votes, 0)
    for _ in range(seats if heap else 0):
        _, p, s = heapq.heappop(heap)
        quota[p] += 1
        heapq.heappush(heap, ((s + 1.5) / votes[p], p, s + 1))
    return quota


def test_sainte_lague(spark):
    rng = random.Random(4)
    groups = {f"g{k}": ({p: rng.choice([0, 1, 2, 7, 7, rng.randint(1, 10**rng.randint(1, 6))]) for p in range(rng.choice([1, 2, 30, 200]))},
                        rng.choice([0, 1, 5, 100, 3000])) for k in range(24)}
    rows = [(g, p, v, q) for g, (votes, q) in groups.items() for p, v in votes.items()]
    got = sm.sainte_lague(spark.createDataFrame(rows, "g string, p int, v long, q long"), "g", "p", "v", "q").collect()
    for g, (votes, q) in groups.items():
        want = {p: n for p, n in brute_seats(votes, q).items() if n}
        assert {r.p: r.quota for r in got if r.g == g and r.quota} == want


def test_mixing(spark, sourced, empty):
    runs = [sorted(map(str, sm.mix_sources(sourced.repartition(k), block=4, shard_words=300).collect())) for k in (2, 5)]
    assert runs[0] == runs[1]
    got = sm.mix_sources(sourced, block=4, shard_words=300).collect()
    docs = sourced.select("doc_id", "source", "text").collect()
    words, size = Counter(), lambda t: len(WORD.findall(t or ""))
    for r in docs:
        words[r.source] += size(r.text)
    target, capped = brute_targets(words)
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((r.doc_id, size(r.text), words[r.source]) for r in docs)
    by_target, taken = {}, Counter()
    for s in words:
        by_target.setdefault((words[s], round(target[s], 6)), s)
    assert len(by_target) == len(words)
    shards = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        s = by_target[r.source_size, round(r.target, 6)]
        taken[s] += r.taken
        shards[s, int(hashlib.md5(f"13:{'' if r.doc_id is None else r.doc_id}:{r.size}".encode()).hexdigest()[:8], 16)
               % max(-(-words[s] // 300), 1)] += r.size
    assert capped and len(capped) < len(words)
    seats = brute_seats({("-" if s is None else "=" + s): target[s] for s in words if s not in capped},
                        int((sum(words.values()) - sum(3 * words[s] for s in capped)) / 4 + 0.5))
    for s in words:
        if s in capped:
            assert taken[s] == 3 * words[s]
            continue
        quota = brute_seats({k: n for (x, k), n in shards.items() if x == s}, seats["-" if s is None else "=" + s])
        assert abs(taken[s] - 4 * sum(quota.values())) <= 2 * len(quota)
    assert sm.mix_sources(empty).collect() == []


def test_mixing_of_one_source_and_of_no_words(spark):
    one = spark.createDataFrame([(1, "a b c", "s"), (2, None, "s"), (None, "d", "s")], "doc_id long, text string, source string")
    assert sorted((r.size, r.target, r.taken) for r in sm.mix_sources(one, block=1).collect()) == [(0, 4.0, 0), (1, 4.0, 1), (3, 4.0, 3)]
    none = spark.createDataFrame([(1, "", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.target, r.taken) for r in sm.mix_sources(none).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


@pytest.mark.parametrize("quota", [0, 1, 3, 9, 10, 11, 25, 29, 30])
def test_selection_of_a_shard(quota):
    sizes = np.array([3, 1, 40, 6, 7, 21])  # 78 words: 9 blocks of 8 and a short one
    taken = sm.select_words(sizes, quota, False, 12345, 8, 3)
    assert (taken >= 0).all() and (taken <= 3 * sizes).all()
    assert abs(int(taken.sum()) - min(8 * quota, 3 * 78)) <= 4
    rounds, before = sm.taken_until(78, quota, False, 12345, 8, 3)
    positions = np.repeat(np.arange(6), sizes)
    picked = [rounds + (before[p // 8 + 1] > before[p // 8]) for p in range(78)]
    assert [sum(n for p, n in zip(positions, picked) if p == d) for d in range(6)] == taken.tolist()
