"""Random forests and boosted trees (M6-M8) grown over blocks of binned rows.

The method is that of Spark ML's estimators, whose parameters are read: quantile bins from a sample, the gain of Gini impurity
or variance, a drawn subset of features for each node, Poisson bootstrap, equal leaves merged, logistic loss for boosting.  Rows
are stored once as blocks of bytes.  For each level, tasks count the rows of every node by class and bin with array operations,
the counts of a node are added up and searched for the best split where they meet, and only splits reach the driver.  A row's node
and its bootstrap weight are found again in each pass from the trees and a seed, so nothing is kept for each row and tree.

The result is Spark's own model, read from its storage format.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.io import scratch_path

#: Most rows of a block, and counters that a task holds at once; trees of a level are taken in turn beyond that.
BLOCK_ROWS, CELLS = 65_536, 12_000_000
#: Rows whose values give the bins (Spark takes 10,000).
SAMPLE_ROWS = 100_000
#: Nodes of a tree whose counters travel together.
NODES = 64
#: Rounds of boosting after which the rows' margins are stored, so that no lineage grows longer.
STORED_ROUNDS = 25


def class_weights(train: DataFrame, estimator) -> tuple[int, np.ndarray] | None:
    """Rows and weights of the classes 0 and 1; None where the estimator's settings, other labels or rows weighted by more than
    their class need Spark's own fit."""
    def value(name: str):
        return estimator.getOrDefault(name) if estimator.isDefined(name) else None

    if value("minInfoGain") or value("minWeightFractionPerNode") or value("thresholds") or value("maxBins") > 256 or not 1 <= value("maxDepth") <= 20:
        return None
    if isinstance(estimator, RandomForestClassifier):
        if value("impurity") != "gini" or value("featureSubsetStrategy") not in ("sqrt", "all") or value("subsamplingRate") != 1.0:
            return None
    elif value("weightCol") or value("featureSubsetStrategy") != "all" or value("validationIndicatorCol"):
        return None
    weight = F.col(value("weightCol")).cast("double") if value("weightCol") else F.lit(1.0)
    found = sorted(train.groupBy(F.col(value("labelCol")).cast("double").alias("y")).agg(
        F.count("*").alias("n"), F.min(weight).alias("low"), F.max(weight).alias("high"), F.count(weight).alias("given")).limit(3).collect(), key=str)
    if [r["y"] for r in found] != [0.0, 1.0] or any(r["low"] != r["high"] or r["given"] != r["n"] or not r["low"] > 0 for r in found):
        return None
    return sum(r["n"] for r in found), np.array([r["low"] for r in found])


# ---------------------------------------------------------------------------
# bins and blocks
# ---------------------------------------------------------------------------
def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 midpoints between the distinct values, at equal shares of the rows."""
    found, counts = np.unique(values, return_counts=True)
    if len(found) < 2:
        return np.empty(0)
    middle = found[:-1] + (found[1:] - found[:-1]) / 2.0
    if len(middle) < bins:
        return middle
    below = np.cumsum(counts)[:-1]
    target = np.arange(1, bins) * (len(values) / bins)
    after = np.minimum(np.searchsorted(below, target), len(below) - 1)
    before = np.maximum(after - 1, 0)
    return middle[np.unique(np.where(target - below[before] <= below[after] - target, before, after))]


def bin_edges(rows: DataFrame, n: int, bins: int, seed: int) -> list[np.ndarray]:
    some = rows.select("x").sample(min(1.0, 1.1 * SAMPLE_ROWS / max(n, 1)), seed) if n > SAMPLE_ROWS else rows.select("x")
    found = some.toArrow().column("x")
    values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in found.chunks]).reshape(len(found), -1)
    return [thresholds(values[:, j], bins) for j in range(values.shape[1])]


def binned_blocks(rows: DataFrame, edges: list[np.ndarray], block_rows: int) -> DataFrame:
    """Stored blocks ``id, x, y``: the bins and classes of rows ``x array<double>, y``, row after row, as bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(edges)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block(some: list) -> pa.RecordBatch:
            x, y = np.concatenate([a for a, _ in some]), np.concatenate([b for _, b in some])
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + at]), pa.array([x.tobytes()], pa.binary()),
                                               pa.array([y.tobytes()], pa.binary())], names=["id", "x", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if not np.isfinite(x).all():
                raise ValueError("features must not be missing, NaN or infinite")  # as Spark's own fit refuses them
            found = np.empty(x.shape, dtype=np.uint8)
            for j, cuts in enumerate(shared.value):
                found[:, j] = np.searchsorted(cuts, x[:, j])
            held.append((found, batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)))
            size += batch.num_rows
            if size >= block_rows:
                yield block(held)
                at, held, size = at + 1, [], 0
        if held:
            yield block(held)

    packed = rows.mapInArrow(pack, "id long, x binary, y binary")
    # dealt out by block, since a filter may have left partitions of any size
    return cut_lineage(packed.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism)))


def _random(*seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.SFC64(np.random.SeedSequence([s & 0xFFFFFFFFFFFFFFFF for s in seed])))


def _poisson_table() -> np.ndarray:
    """Poisson(1) by 65,536 equally likely numbers."""
    cumulated, total = [], 0.0
    for k in range(20):
        total += math.exp(-1.0) / math.factorial(k)
        cumulated.append(total)
    return np.searchsorted(np.array(cumulated), (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)


_POISSON = _poisson_table()


def bootstrap_counts(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often each row of the block is drawn for the tree; the same in every pass."""
    return _POISSON.take(_random(seed, tree, block).integers(0, 65_536, n, dtype=np.uint16))


def nodes_at(x: np.ndarray, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
    """Heap position below ``level`` of the rows that begin at ``at`` in ``x``; rows of a leaf further up go left."""
    node, place = np.zeros(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
    value, limit, beyond = np.empty(len(at), dtype=np.uint8), np.empty(len(at), dtype=np.uint8), np.empty(len(at), dtype=bool)
    for _ in range(level):
        feature.take(node, out=place, mode="clip")  # no place is out of range; other modes copy the output
        place += at
        np.greater(x.take(place, out=value, mode="clip"), cut.take(node, out=limit, mode="clip"), out=beyond)
        node += node
        node += 1
        node += beyond
    return node


# ---------------------------------------------------------------------------
# forests
# ---------------------------------------------------------------------------
def _gini(stats: np.ndarray) -> np.ndarray:
    total = stats.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, 1.0 - ((stats / total[..., None]) ** 2).sum(axis=-1), 0.0)


def best_gini_splits(counts: np.ndarray, weights: np.ndarray, least: int) -> tuple:
    """For each node of ``counts`` (node, feature, bin, class): place of the feature, bin, gain (0: no split), rows by class left."""
    below = counts.cumsum(axis=2)[:, :, :-1]
    total = counts[:, :1].sum(axis=2, keepdims=True)
    above = total - below
    left, right, whole = below * weights, above * weights, total * weights
    size = whole.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _gini(whole) - (left.sum(axis=-1) * _gini(left) + right.sum(axis=-1) * _gini(right)) / size
    gain = np.where((below.sum(axis=-1) >= least) & (above.sum(axis=-1) >= least), gain, -1.0).reshape(len(counts), -1)
    best = gain.argmax(axis=1)
    place, cut = np.divmod(best, counts.shape[2] - 1)
    every = np.arange(len(counts))
    return place, cut, np.maximum(gain[every, best], 0.0), below[every, place, cut]


def grow_forest(blocks: DataFrame, edges: list[np.ndarray], weights: np.ndarray, trees: int, depth: int, least: int, subset: int,
                bootstrap: bool, seed: int) -> dict[str, np.ndarray]:
    """``feature`` (-1: leaf), ``cut``, ``gain`` and ``counts`` (rows by class) of every heap position of every tree."""
    sc, width, bins = blocks.sparkSession.sparkContext, len(edges), max(2, max(len(e) for e in edges) + 1)
    rows = blocks.rdd.map(lambda r: (r["id"], bytes(r["x"]), bytes(r["y"]))).persist(StorageLevel.MEMORY_AND_DISK)
    places, parts = 2 ** (depth + 1) - 1, max(1, sc.defaultParallelism)
    feature, cut = np.full((trees, places), -1, dtype=np.int16), np.zeros((trees, places), dtype=np.uint8)
    gain, counts = np.zeros((trees, places), dtype=np.float32), np.zeros((trees, places, 2), dtype=np.int64)
    growing = [np.zeros(1, dtype=np.int64)] * trees  # heap positions of the level that may still be split
    draw = np.random.default_rng([seed & 0xFFFFFFFF, 1])

    def step(chosen: list[int], level: int) -> None:
        first, tables = 2 ** level - 1, {}
        for t in chosen:
            slot = np.full(2 ** level, -1, dtype=np.int64)
            slot[growing[t] - first] = np.arange(len(growing[t]))
            some = np.broadcast_to(np.arange(width), (len(growing[t]), width))
            if subset < width:
                some = draw.random((len(growing[t]), width)).argpartition(subset, axis=1)[:, :subset]
            inner = feature[t, :first]
            tables[t] = (np.maximum(inner, 0).astype(np.int64), np.where(inner < 0, 255, cut[t, :first]).astype(np.uint8), slot,
                         np.ascontiguousarray(some.T.astype(np.int64)))
        shared = sc.broadcast(tables)

        def count(held: Iterator[tuple]) -> Iterator[tuple]:
            sums = {t: np.zeros((subset, table[3].shape[1] * bins * 2), dtype=np.int32) for t, table in shared.value.items()}
            for block, raw, labels in held:
                x, y = np.frombuffer(raw, dtype=np.uint8), np.frombuffer(labels, dtype=np.uint8).astype(np.int64)
                starts = np.arange(len(y), dtype=np.int64) * width
                for t, (feat, cuts, slot, some) in shared.value.items():
                    at, own, drawn = starts, y, None
                    if bootstrap:
                        drawn = bootstrap_counts(seed, t, block, len(y))
                        kept = np.flatnonzero(drawn)
                        at, own, drawn = kept * width, y.take(kept), drawn.take(kept).astype(float)
                    node = slot.take(nodes_at(x, at, feat, cuts, level) - first)
                    if (slot < 0).any():
                        kept = np.flatnonzero(node >= 0)
                        node, at, own = node.take(kept), at.take(kept), own.take(kept)
                        drawn = None if drawn is None else drawn.take(kept)
                    own = own + node * (bins * 2)
                    out = sums[t]
                    for j in range(subset):
                        cell = x.take(at + some[j].take(node)).astype(np.int64)
                        cell += cell
                        cell += own
                        np.add(out[j], np.bincount(cell, drawn, out.shape[1]), out=out[j], casting="unsafe")
            for t, out in sums.items():
                nodes = out.reshape(subset, -1, bins * 2)
                for k in range(0, nodes.shape[1], NODES):
                    yield (t, k), np.ascontiguousarray(nodes[:, k:k + NODES])

        def search(held: Iterator[tuple]) -> Iterator[tuple]:
            sums: dict[tuple, np.ndarray] = {}
            for key, out in held:
                sums[key] = sums[key] + out if key in sums else out.astype(np.int64)
            for (t, k), out in sums.items():
                split = out.reshape(subset, -1, bins, 2).transpose(1, 0, 2, 3)
                place, at, found, left = best_gini_splits(split, weights, least)
                some = shared.value[t][3][:, k:k + len(split)]
                yield t, k, some[place, np.arange(len(split))], at, found, split[:, 0].sum(axis=1), left

        spread = rows.mapPartitions(count).partitionBy(parts, lambda key: key[0] * 1009 + key[1] // NODES)
        for t, k, feat, at, found, here, left in spread.mapPartitions(search).collect():
            here_at = growing[t][k:k + len(feat)]
            counts[t, here_at] = here
            split = found > 0
            inner = here_at[split]
            feature[t, inner], cut[t, inner], gain[t, inner] = feat[split], at[split], found[split]
            counts[t, 2 * inner + 1], counts[t, 2 * inner + 2] = left[split], here[split] - left[split]
        shared.destroy()

    try:
        for level in range(depth):
            left = [t for t in range(trees) if len(growing[t])]
            while left:
                size, chosen = 0, []
                while left and (not chosen or size + len(growing[left[0]]) * subset * bins * 2 <= CELLS):
                    size += len(growing[left[0]]) * subset * bins * 2
                    chosen.append(left.pop(0))
                step(chosen, level)
            for t in range(trees):
                inner = growing[t][feature[t, growing[t]] >= 0]
                below = np.sort(np.concatenate([2 * inner + 1, 2 * inner + 2]))
                growing[t] = below[(counts[t, below] > 0).all(axis=1)]  # both classes
    finally:
        rows.unpersist()
    # two leaves with the same prediction are one (Spark's pruning)
    predicted = (counts * weights).argmax(axis=-1)
    for level in range(depth - 1, -1, -1):
        at = np.arange(2 ** level - 1, 2 ** (level + 1) - 1)
        same = (feature[:, at] >= 0) & (feature[:, 2 * at + 1] < 0) & (feature[:, 2 * at + 2] < 0) & (
            predicted[:, 2 * at + 1] == predicted[:, 2 * at + 2])
        feature[:, at] = np.where(same, -1, feature[:, at])
    return {"feature": feature, "cut": cut, "gain": gain, "counts": counts}


# ---------------------------------------------------------------------------
# boosting
# ---------------------------------------------------------------------------
def _best_variance_splits(hist: np.ndarray, least: int) -> tuple:
    """For each node of ``hist`` (node, feature, bin, count / sum[ / squares]): feature, bin, gain and statistics left."""
    below = hist.cumsum(axis=2)[:, :, :-1]
    total = hist[:, :1].sum(axis=2, keepdims=True)
    above = total - below
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (below[..., 1] ** 2 / below[..., 0] + above[..., 1] ** 2 / above[..., 0] - total[..., 1] ** 2 / total[..., 0]) / total[..., 0]
    gain = np.where((below[..., 0] >= least) & (above[..., 0] >= least), gain, -1.0).reshape(len(hist), -1)
    best = gain.argmax(axis=1)
    feature, cut = np.divmod(best, hist.shape[2] - 1)
    every = np.arange(len(hist))
    return feature, cut, gain[every, best], below[every, feature, cut]


def grow_boosted(blocks: DataFrame, edges: list[np.ndarray], rounds: int, step: float, depth: int, least: int, share: float,
                 seed: int) -> list[dict[str, np.ndarray]]:
    """Regression trees on the gradient of the logistic loss; the first fits the labels -1 and 1."""
    sc, width, bins = blocks.sparkSession.sparkContext, len(edges), max(2, max(len(e) for e in edges) + 1)

    def begin(r) -> tuple:
        n = len(r["y"])
        by_column = np.frombuffer(bytes(r["x"]), dtype=np.uint8).reshape(n, width).T
        return r["id"], by_column.tobytes(), bytes(r["y"]), np.zeros(n).tobytes()

    state, old, stored = blocks.rdd.map(begin).persist(StorageLevel.MEMORY_AND_DISK), None, []
    places, grown = 2 ** (depth + 1) - 1, []

    def added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        return [x + y for x, y in zip(a, b)]

    def histograms(state, tree: dict, level: int, wanted: np.ndarray, number: int) -> list[np.ndarray]:
        """Statistics of the heap positions ``wanted`` by feature and bin, and their sums of squares."""
        first, kinds = 2 ** level - 1, 3 if level == depth - 1 else 2
        slot = np.full(2 ** level, -1, dtype=np.int64)
        slot[wanted - first] = np.arange(len(wanted))
        inner = tree["feature"][:first]
        feat, cuts = np.maximum(inner, 0).astype(np.int64), np.where(inner < 0, 255, tree["cut"][:first]).astype(np.uint8)
        whole = level == 0

        def count(held: Iterator[tuple]) -> Iterator[list[np.ndarray]]:
            hist, squares = np.zeros((len(wanted), width, bins, kinds)), np.zeros(len(wanted))
            for block, raw, labels, margins in held:
                x, n = np.frombuffer(raw, dtype=np.uint8), len(labels)
                sign = np.frombuffer(labels, dtype=np.uint8) * 2.0 - 1.0
                if number == 0:
                    target = sign
                else:
                    with np.errstate(over="ignore"):
                        target = 4.0 * sign / (1.0 + np.exp(2.0 * sign * np.frombuffer(margins, dtype=float)))
                at = np.arange(n, dtype=np.int64)
                if share < 1.0:
                    at = np.flatnonzero(_random(seed, number, block, 2).random(n, dtype=np.float32) < share)
                place = np.zeros(len(at), dtype=np.int64)
                if not whole:
                    place = slot.take(_column_nodes(x, at, n, feat, cuts, level) - first)
                    kept = np.flatnonzero(place >= 0)
                    at, place = at.take(kept), place.take(kept)
                own = target.take(at)
                square = own * own
                squares += np.bincount(place, square, len(wanted))
                place = place * bins
                for j in range(width):
                    cell = x[j * n:(j + 1) * n].take(at) + place
                    hist[:, j, :, 0] += np.bincount(cell, None, len(wanted) * bins).reshape(len(wanted), bins)
                    hist[:, j, :, 1] += np.bincount(cell, own, len(wanted) * bins).reshape(len(wanted), bins)
                    if kinds == 3:
                        hist[:, j, :, 2] += np.bincount(cell, square, len(wanted) * bins).reshape(len(wanted), bins)
            yield [hist, squares]

        parts = state.mapPartitions(count)
        return parts.treeReduce(added) if parts.getNumPartitions() > 64 else reduce(added, parts.collect())

    for number in range(rounds):
        tree = {"feature": np.full(places, -1, dtype=np.int16), "cut": np.zeros(places, dtype=np.uint8), "gain": np.zeros(places),
                "stats": np.zeros((places, 3)), "mean": np.zeros(places)}
        growing, before, whole_squares = np.zeros(1, dtype=np.int64), {}, {}
        for level in range(depth):
            if not len(growing):
                break
            last = level == depth - 1
            # of two siblings the one with fewer rows is counted, the other is what their parent has beside it; the last level
            # counts both, since it needs squares by bin, too
            wanted = growing
            if level and not last:
                pairs, size = growing.reshape(-1, 2), tree["stats"][:, 0]
                wanted = np.where(size[pairs[:, 0]] <= size[pairs[:, 1]], pairs[:, 0], pairs[:, 1])
            hist, squares = histograms(state, tree, level, wanted, number)
            if old is not None:
                old.unpersist()
                old = None
                if state.is_checkpointed:
                    stored.append(state.getCheckpointFile())
                    for path in stored[:-1]:
                        _delete(sc, path)
                    del stored[:-1]
            here = {int(p): hist[i] for i, p in enumerate(wanted)}
            here_squares = {int(p): squares[i] for i, p in enumerate(wanted)}
            for p in growing:
                if int(p) not in here:
                    other = int(p + 1 if p % 2 else p - 1)
                    here[int(p)] = before[(int(p) - 1) // 2] - here[other]
                    here_squares[int(p)] = whole_squares[(int(p) - 1) // 2] - here_squares[other]
            stacked = np.stack([here[int(p)] for p in growing])
            feature, cut, gain, left = _best_variance_splits(stacked, least)
            sums = stacked[:, 0].sum(axis=1)
            for i, p in enumerate(growing):
                tree["stats"][p] = *sums[i, :2], here_squares[int(p)]
            for i in np.flatnonzero(gain > 1e-15):
                p = growing[i]
                tree["feature"][p], tree["cut"][p], tree["gain"][p] = feature[i], cut[i], gain[i]
                tree["stats"][2 * p + 1, :left.shape[1]] = left[i]
                tree["stats"][2 * p + 2, :left.shape[1]] = sums[i] - left[i]
            inner = growing[tree["feature"][growing] >= 0]
            growing, before, whole_squares = np.sort(np.concatenate([2 * inner + 1, 2 * inner + 2])), here, here_squares
        with np.errstate(divide="ignore", invalid="ignore"):
            tree["mean"] = np.where(tree["stats"][:, 0] > 0, tree["stats"][:, 1] / tree["stats"][:, 0], 0.0)
        for p in range(places // 2):  # a leaf's rows end on the far left below it
            if tree["feature"][p] < 0:
                tree["mean"][2 * p + 1] = tree["mean"][p]
        grown.append(tree)
        if number == rounds - 1:
            break
        weight = 1.0 if number == 0 else step

        def update(row: tuple, tree: dict = tree, weight: float = weight) -> tuple:
            block, raw, labels, margins = row
            n, inner = len(labels), tree["feature"]
            low = _column_nodes(np.frombuffer(raw, dtype=np.uint8), np.arange(n, dtype=np.int64), n, np.maximum(inner, 0).astype(np.int64),
                                np.where(inner < 0, 255, tree["cut"]).astype(np.uint8), depth)
            return block, raw, labels, (np.frombuffer(margins, dtype=float) + weight * tree["mean"].take(low)).tobytes()

        old, state = state, state.map(update).persist(StorageLevel.MEMORY_AND_DISK)
        if (number + 1) % STORED_ROUNDS == 0:
            state.checkpoint()
    state.unpersist()
    for path in stored:
        _delete(sc, path)
    return grown


def _column_nodes(x: np.ndarray, at: np.ndarray, n: int, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
    """:func:`nodes_at` for the rows ``at`` of ``n`` that are stored column after column."""
    return nodes_at(x, at, feature * n, cut, level)


def _delete(sc, path: str) -> None:
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


# ---------------------------------------------------------------------------
# Spark's models
# ---------------------------------------------------------------------------
def _node_table(number: int, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, stats: np.ndarray, raw: np.ndarray, prediction: np.ndarray,
                impurity: np.ndarray, edges: list[np.ndarray]) -> pa.Table:
    """The nodes of a tree in Spark's storage format, numbered level by level."""
    reached, parents = [np.zeros(1, dtype=np.int64)], None
    while len(reached[-1]):
        parents = reached[-1][feature[reached[-1]] >= 0]
        reached.append(np.stack([2 * parents + 1, 2 * parents + 2], axis=1).reshape(-1))
    at = np.concatenate(reached)
    ids = np.full(len(feature) + 1, -1, dtype=np.int32)
    ids[at] = np.arange(len(at), dtype=np.int32)
    inner = feature[at] >= 0
    left, right = np.full(len(at), -1, dtype=np.int32), np.full(len(at), -1, dtype=np.int32)
    left[inner], right[inner] = ids[2 * at[inner] + 1], ids[2 * at[inner] + 2]
    cuts = [edges[f][c] for f, c in zip(feature[at[inner]], cut[at[inner]])]
    ends = np.concatenate([[0], np.cumsum(inner)]).astype(np.int32)
    # a leaf has the split -1 without values
    split = pa.StructArray.from_arrays(
        [pa.array(np.where(inner, feature[at], -1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(cuts, dtype=float))),
         pa.array(np.full(len(at), -1, dtype=np.int32))], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    width = stats.shape[1]
    data = pa.StructArray.from_arrays(
        [pa.array(np.arange(len(at), dtype=np.int32)), pa.array(prediction[at].astype(float)), pa.array(impurity[at].astype(float)),
         pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(at) + 1, width, dtype=np.int32)), pa.array(stats[at].astype(float).reshape(-1))),
         pa.array(raw[at].astype(np.int64)), pa.array(np.where(inner, gain[at], -1.0).astype(float)), pa.array(left), pa.array(right), split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.table({"treeID": pa.array(np.full(len(at), number, dtype=np.int32)), "nodeData": data})


def _as_model(spark: SparkSession, estimator, kind, tree_class: str, tables: list[pa.Table], weights: Sequence[float], width: int, more: dict):
    """Spark's model, written in its storage format and loaded."""
    path, now = scratch_path(spark, "trees"), int(time.time() * 1000)
    given = {p.name: estimator.getOrDefault(p) for p in estimator.params if estimator.isSet(p)}
    default = {p.name: estimator.getOrDefault(p) for p in estimator.params if estimator.hasDefault(p) and not estimator.isSet(p)}

    def metadata(class_name: str, uid: str, extra: dict, params: dict) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.{class_name}", "timestamp": now, "sparkVersion": spark.version, "uid": uid,
                           "paramMap": params, "defaultParamMap": default if extra else {}, **extra})

    shared = {k: v for k, v in given.items() if k in ("featuresCol", "labelCol", "maxDepth", "minInstancesPerNode", "seed", "maxBins")}
    text = metadata(f"classification.{kind.__name__}", estimator.uid, {"numFeatures": width, "numTrees": len(tables), **more}, given)
    trees = [(i, metadata(tree_class, f"{estimator.uid}_{i}", {}, shared), float(w)) for i, w in enumerate(weights)]
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(pa.concat_tables(tables)).write.parquet(f"{path}/data")
    return kind.load(path)


def fit_trees(train: DataFrame, estimator):
    """Spark's model of a random forest or boosted trees for the estimator's columns of ``train``; None as in :func:`class_weights`."""
    found = class_weights(train, estimator)
    if found is None:
        return None
    spark, seed, (n, weights) = train.sparkSession, estimator.getSeed(), found
    label = F.col(estimator.getLabelCol()).cast("int")
    rows = train.select(vector_to_array(estimator.getFeaturesCol()).alias("x"), label.alias("y"))
    cores = max(1, spark.sparkContext.defaultParallelism)
    edges = bin_edges(rows, n, estimator.getMaxBins(), seed)
    blocks = binned_blocks(rows, edges, min(BLOCK_ROWS, max(1024, n // (4 * cores))))
    width, depth, least = len(edges), estimator.getMaxDepth(), estimator.getMinInstancesPerNode()
    if isinstance(estimator, RandomForestClassifier):
        subset = width if estimator.getFeatureSubsetStrategy() == "all" else math.ceil(math.sqrt(width))
        forest = grow_forest(blocks, edges, weights, estimator.getNumTrees(), depth, least, subset, estimator.getBootstrap(), seed)
        tables = []
        for t in range(estimator.getNumTrees()):
            stats = forest["counts"][t] * weights
            tables.append(_node_table(t, forest["feature"][t], forest["cut"][t], forest["gain"][t], stats, forest["counts"][t].sum(axis=-1),
                                      stats.argmax(axis=-1), _gini(stats), edges))
        return _as_model(spark, estimator, RandomForestClassificationModel, "classification.DecisionTreeClassificationModel", tables,
                         [1.0] * len(tables), width, {"numClasses": 2})
    trees = grow_boosted(blocks, edges, estimator.getMaxIter(), estimator.getStepSize(), depth, least, estimator.getSubsamplingRate(), seed)
    tables = []
    for t, tree in enumerate(trees):
        size = np.maximum(tree["stats"][:, 0], 1.0)
        spread = np.maximum(tree["stats"][:, 2] / size - (tree["stats"][:, 1] / size) ** 2, 0.0)
        tables.append(_node_table(t, tree["feature"], tree["cut"], tree["gain"], tree["stats"], tree["stats"][:, 0], tree["mean"], spread, edges))
    return _as_model(spark, estimator, GBTClassificationModel, "regression.DecisionTreeRegressionModel", tables,
                     [1.0] + [estimator.getStepSize()] * (len(trees) - 1), width, {})
