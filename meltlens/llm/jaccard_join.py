"""Operator 8 - n-gram Jaccard join by several global token orders.

A document's set holds the 64-bit hashes of its distinct five-word shingles.
Rows with the same words are one class (64-bit hash of the words), so copies
never meet as pairs.  Two classes that link must share tokens near the front
of both sets under *every* global order of the tokens; the filters of several
orders are intersected before anything is verified:

1. Hash order, extended prefix.  Each class sends the first
   ``n - ceil(0.75 n) + ell(n)`` hashes of its set.  A class that links with any
   other must find at least ``ell(ceil(0.75 n))`` of them in other classes.
   Blocks of classes send sorted 32-bit remainders by hash range; a token that
   many classes of a block hold is sent twice only (the others are counted on
   the spot), so a passage on a third of all rows stays small.
2. Rarest first, over the classes left: exact document frequencies, ordinary
   prefix, and the bound that the tokens from a shared one onwards give on the
   overlap.  Tokens of one class take up the prefix and are not sent on.
3. Ascending and descending hash order for each pair, then the exact overlap.

Not all pairs of a token's classes are made.  First every class meets the
token's most central class (the one with the fewest rare tokens).  Linked
classes are contracted to components; only tokens that still join different
components have their cross pairs verified, all of them, so no link between
components is lost.

Defined results: null, empty and blank texts have an empty set and are their
own component; fewer than five words make one shingle; rows with equal words
share a component whatever their ids; null ids are ignored when the smallest id
is chosen; extra columns are ignored (``join_documents``) or carried
(``keep_one``); an empty table gives an empty result.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

SHINGLE = 5
#: Prefix hashes a block of classes gathers before it is sent.
BLOCK_TOKENS = 1 << 19
#: Characters of text for each hash range (about one million prefix hashes).
RANGE_CHARS = 20_000_000
#: Class ids that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST_CLASSES = 1_000_000

MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCK_SCHEMA = ("range int, tokens binary, refs binary, classes binary, sizes binary, "
                "more_classes binary, more_sizes binary, more_counts binary")


def least_overlap(n):
    """ceil(0.75 n): tokens that a linked class shares at least."""
    return (3 * n + 3) // 4


def ell(m):
    """Prefix tokens that classes linked by m common tokens must share."""
    return 3 * m // 20 + 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(words: pa.ListArray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (signed) of each list of word hashes."""
    offsets = words.offsets.to_numpy()
    first = int(offsets[0])
    flat = words.values[first:int(offsets[-1])].to_numpy(zero_copy_only=False).view(np.uint64)
    offsets = offsets - first
    rolled = np.zeros(max(len(flat) - SHINGLE + 1, 0), dtype=np.uint64)
    for k in range(SHINGLE):
        rolled = mixed(rolled * MIX + flat[k:k + len(rolled)])
    signed, out = rolled.view(np.int64), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(signed[a:b - SHINGLE + 1]))
        elif b > a:  # fewer words: the whole sequence is one shingle, told apart by its length
            h = np.array([b - a], dtype=np.uint64)
            for w in flat[a:b]:
                h = mixed(h * MIX + w)
            out.append(h.view(np.int64))
        else:
            out.append(np.empty(0, dtype=np.int64))
    return out


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that a worker holds the hashes of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", -1), "")


def hashed_words(df: DataFrame, text_col: str, *kept: Column) -> DataFrame:
    """Columns kept, c (class of the words, null without any), w (word hashes)."""
    rows = df.select(*kept, words_of(F.col(text_col)).alias("words"))
    c = F.when(F.size("words") > 0, F.xxhash64("words"))
    return rows.select(*[k for k in rows.columns if k != "words"], c.alias("c"),
                       F.transform("words", lambda x: F.xxhash64(x)).alias("w"))


def send_prefixes(ranges: int):
    """Blocks of hash-order prefixes, one row per block and hash range."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[np.ndarray] = []
        classes: dict[int, int] = {}
        gathered = 0
        for batch in small_batches(batches):
            for c, tokens in zip(batch.column("c").to_pylist(), shingle_sets(batch.column("w"))):
                if c in classes or not len(tokens):
                    continue
                n = len(tokens)
                classes[c] = n
                heads.append(tokens[:n - least_overlap(n) + ell(n)])
                gathered += len(heads[-1])
                if gathered >= BLOCK_TOKENS:
                    yield pack_block(heads, classes, ranges)
                    heads, classes, gathered = [], {}, 0
        if heads:
            yield pack_block(heads, classes, ranges)

    return send


def pack_block(heads: list[np.ndarray], classes: dict[int, int], ranges: int) -> pa.RecordBatch:
    ids = np.fromiter(classes.keys(), dtype=np.int64, count=len(classes))
    sizes = np.fromiter(classes.values(), dtype=np.int32, count=len(classes))
    tokens = mixed(np.concatenate(heads).view(np.uint64))
    refs = np.repeat(np.arange(len(heads), dtype=np.uint32), [len(h) for h in heads])
    order = np.argsort(tokens, kind="stable")
    tokens, refs = tokens[order], refs[order]
    first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    nth = np.arange(len(tokens)) - np.repeat(first, np.diff(np.r_[first, len(tokens)]))
    more = np.bincount(refs[nth >= 2], minlength=len(ids))
    tokens, refs = tokens[nth < 2], refs[nth < 2]
    at = ((tokens >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    rows: list[tuple] = []
    bounds = np.searchsorted(at, np.arange(ranges + 1, dtype=np.uint64))
    with_more, target = np.flatnonzero(more), int(tokens[0] % np.uint64(ranges))
    for r in range(ranges):
        lo, hi = bounds[r], bounds[r + 1]
        own = with_more if r == target else with_more[:0]
        if lo == hi and not len(own):
            continue
        held, local = np.unique(refs[lo:hi], return_inverse=True)
        rows.append((r, tokens[lo:hi].astype(np.uint32).tobytes(), local.astype(np.uint32).tobytes(), ids[held].tobytes(),
                     sizes[held].tobytes(), ids[own].tobytes(), sizes[own].tobytes(), more[own].astype(np.int32).tobytes()))
    columns = [pa.array([row[0] for row in rows], pa.int32())]
    columns += [pa.array([row[k] for row in rows], pa.binary()) for k in range(1, 8)]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")])


def count_shared(parts: int):
    """Per hash range: how many of its prefix tokens another class has too, for each class.

    One row for each of ``parts`` groups of classes, so the rows do not grow with the classes."""

    def count(blocks: pd.DataFrame) -> pd.DataFrame:
        refs, base = [], 0
        for raw, held in zip(blocks["refs"], blocks["classes"]):
            refs.append(np.frombuffer(raw, dtype=np.uint32).astype(np.int64) + base)
            base += len(held) // 8
        join = lambda name, kind: np.frombuffer(b"".join(blocks[name]), dtype=kind)
        tokens, ids, sizes = join("tokens", np.uint32), join("classes", np.int64), join("sizes", np.int32)
        refs = np.concatenate(refs)
        unique, first_at, numbered = np.unique(ids, return_index=True, return_inverse=True)
        pairs = np.unique((tokens.astype(np.uint64) << np.uint64(32)) | numbered[refs].astype(np.uint64))
        held = pairs >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else np.empty(0, dtype=np.int64)
        many = np.repeat(np.diff(np.r_[first, len(held)]) > 1, np.diff(np.r_[first, len(held)]))
        counts = np.bincount((pairs[many] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(unique))
        hit = np.flatnonzero(counts)
        c = np.concatenate([unique[hit], join("more_classes", np.int64)])
        n = np.concatenate([sizes[first_at][hit], join("more_sizes", np.int32)])
        k = np.concatenate([counts[hit].astype(np.int32), join("more_counts", np.int32)])
        part = (mixed(c.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, *(x[order[lo:hi]].tobytes() for x in (c, n, k)))
                for p, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])) if hi > lo]
        return pd.DataFrame(rows, columns=["part", "classes", "sizes", "counts"])

    return count


def pass_first_filter(rows: pd.DataFrame) -> pd.DataFrame:
    """Classes of one group that share enough prefix tokens, over all hash ranges."""
    join = lambda name, kind: np.frombuffer(b"".join(rows[name]), dtype=kind)
    c, first, numbered = np.unique(join("classes", np.int64), return_index=True, return_inverse=True)
    n = join("sizes", np.int32)[first].astype(np.int64)
    shared = np.bincount(numbered, join("counts", np.int32), minlength=len(c))
    passed = shared >= ell(least_overlap(n))
    return pd.DataFrame({"c": c[passed], "n": n[passed]})


def first_filter(df: DataFrame, text_col: str) -> DataFrame:
    """Classes (c, n) that pass the hash-order filter."""
    chars = df.agg(F.sum(F.length(F.col(text_col)))).head()[0] or 0
    ranges = 1 + chars // RANGE_CHARS
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = hashed_words(df, text_col).where("c is not null")
    blocks = words.mapInArrow(send_prefixes(ranges), BLOCK_SCHEMA)
    counts = blocks.groupBy("range").applyInPandas(count_shared(parts), "part int, classes binary, sizes binary, counts binary")
    return counts.groupBy("part").applyInPandas(pass_first_filter, "c long, n long")


def measure_sets(df: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns id, c, n, part, tokens: every row, with the set where its class is chosen
    (once per partition; ``part`` tells the partitions apart)."""
    rows = hashed_words(df, text_col, F.col(id_col).alias("id"))
    flags = chosen.select("c", F.lit(True).alias("chosen"))
    if chosen.limit(MAX_BROADCAST_CLASSES + 1).count() <= MAX_BROADCAST_CLASSES:
        flags = F.broadcast(flags)
    rows = rows.join(flags, "c", "left").select("id", "c", "w", "chosen", F.spark_partition_id().alias("part"))
    kind = dict(rows.dtypes)["id"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in small_batches(batches):
            sizes, tokens = [], []
            for c, chosen_row, found in zip(batch.column("c").to_pylist(), batch.column("chosen").to_pylist(),
                                            shingle_sets(batch.column("w"))):
                sizes.append(len(found))
                tokens.append(found if chosen_row and c not in given else None)
                if chosen_row:
                    given.add(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("c"), pa.array(sizes, pa.int64()), batch.column("part"),
                 pa.array(tokens, pa.list_(pa.int64()))], names=["id", "c", "n", "part", "tokens"])

    return rows.mapInArrow(measure, f"id {kind}, c long, n long, part int, tokens array<long>")


def rare_first_prefixes(sets: DataFrame) -> DataFrame:
    """Rows (token, c, n, rest): prefix tokens that several classes hold, rarest first; ``rest``
    counts the class's tokens from this one onwards."""
    tokens = sets.select("c", "n", F.explode("tokens").alias("token"))
    several = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(several, "token")
    ranked = shared.withColumn("nth", F.row_number().over(Window.partitionBy("c").orderBy("df", "token")))
    held = shared.groupBy("c").agg(F.count("*").alias("shared"))
    rest = F.col("shared") - F.col("nth") + 1  # tokens of one class come before all shared ones
    return (ranked.join(held, "c").withColumn("rest", rest)
            .where(F.col("rest") >= F.floor((3 * F.col("n") + 3) / 4)).select("token", "c", "n", "rest"))


def can_link(rest: Column, n: Column, rest2: Column, n2: Column) -> Column:
    return 7 * F.least(rest, rest2) >= 3 * (n + n2)


def pairs_of(c: Column, d: Column) -> list[Column]:
    return [F.least(c, d).alias("a"), F.greatest(c, d).alias("b")]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that pass the ascending and descending hash orders and whose sets link."""
    side = lambda name: sets.select(
        F.col("c").alias(name), F.col("n").alias(f"n_{name}"), F.col("tokens").alias(f"t_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    front = lambda x: F.slice(f"t_{x}", F.lit(1), prefix(x))
    back = lambda x: F.slice(f"t_{x}", -prefix(x), prefix(x))
    prefix = lambda x: (F.col(f"n_{x}") - F.floor((3 * F.col(f"n_{x}") + 3) / 4) + 1).cast("int")
    common = F.size(F.array_intersect("t_a", "t_b"))
    return (both.where(F.arrays_overlap(front("a"), front("b")) & F.arrays_overlap(back("a"), back("b")))
            .where(7 * common >= 3 * (F.col("n_a") + F.col("n_b"))).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """Columns c, root: each linked class and the smallest class it reaches (large and small stars)."""
    edges = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small stars: every edge (v > u) hangs v and u below the least neighbour of v
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v"))
        edges = stored(small.where("u <> v").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head())
        if now == before or not now[0]:
            break
        before = now
    pointed = edges.select(F.col("v").alias("c"), F.col("u").alias("root"))
    return pointed.unionByName(edges.select(F.col("u").alias("c"), F.col("u").alias("root")).distinct())


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_classes(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, c, n), verified links (a, b) between classes, and roots (c, root)."""
    spark = df.sparkSession
    chosen = stored(first_filter(df, text_col), "chosen")
    release(spark)
    measured = stored(measure_sets(df, chosen, id_col, text_col), "measured")
    documents = measured.select("id", "c", "n")
    held = measured.where("tokens is not null")
    once = held.groupBy("c").agg(F.min("part").alias("part"))
    sets = stored(held.join(once, ["c", "part"]).select("c", "n", "tokens"), "sets")
    release(spark)
    rows = stored(rare_first_prefixes(sets), "prefixes")
    release(spark)

    # the most central class of each token: the largest share of shared tokens
    hub = rows.groupBy("token").agg(F.max(F.struct(F.col("rest") / F.col("n"), "c", "n", "rest")).alias("hub"))
    met = rows.join(hub, "token").where(
        (F.col("c") != F.col("hub.c")) & can_link(F.col("rest"), F.col("n"), F.col("hub.rest"), F.col("hub.n")))
    tested = stored(met.select(*pairs_of(F.col("c"), F.col("hub.c"))).distinct(), "pairs")
    links = stored(verified(tested, sets), "links")
    release(spark)
    roots = components(links)

    named = rows.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    open_tokens = named.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
    left = stored(named.join(open_tokens, "token", "left_semi"), "open")
    other = left.select("token", *[F.col(x).alias(f"{x}2") for x in ("c", "n", "rest", "root")])
    cross = left.join(other, "token").where(
        (F.col("root") < F.col("root2")) & can_link(F.col("rest"), F.col("n"), F.col("rest2"), F.col("n2")))
    rest = cross.select(*pairs_of(F.col("c"), F.col("c2"))).distinct().join(tested, ["a", "b"], "left_anti")
    late = stored(verified(rest, sets), "links")
    release(spark)
    if late.isEmpty():
        return documents, links, roots
    links = links.unionByName(late)
    return documents, links, components(links)


def first_of_component(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Columns c, k: for each class its component's first row (id null last, id, class)."""
    classes = rows.where("c is not null").groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("x"), "id", "c")).alias("k"))
    named = classes.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    first = named.groupBy("root").agg(F.min("k").alias("k"))
    return named.select("c", "root").join(first, "root").select("c", "k")


def join_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: id, n_shingles, component_id, class - one row per input row."""
    rows, _, roots = join_classes(df, id_col, text_col)
    out = rows.join(first_of_component(rows, roots).select("c", F.col("k.id").alias("least")), "c", "left")
    component = F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("c").alias("class"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` (all its columns) with one row of each component: the smallest id; rows without words stay."""
    rows, _, roots = join_classes(df, id_col, text_col)
    first = first_of_component(rows, roots).where("c = k.c")
    keepers = first.select(F.col("k.id").alias("__id"), F.col("k.c").alias("__c"))
    words = words_of(F.col(text_col))
    named_rows = df.withColumn("__c", F.when(F.size(words) > 0, F.xxhash64(words)))
    same = named_rows["__c"] == keepers["__c"]
    kept = (named_rows.join(keepers, same & named_rows[id_col].eqNullSafe(keepers["__id"]), "left_semi")
            .dropDuplicates(["__c"]))
    empty = named_rows.where("__c is null")
    return kept.unionByName(empty).select(*[F.col(c) for c in df.columns])


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents")).drop("class")


OP8_SQL = r"""
with recursive d as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct rid, hash(array_to_string(w[i:i + 4], ' ')) as t
  from (select rid, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select rid, count(*) as n from s group by rid),
o as (select a.rid as a, b.rid as b, count(*) as k from s a join s b on a.t = b.t and a.rid < b.rid group by all),
l as (
  select a, b from o join n na on na.rid = a join n nb on nb.rid = b
  where 100 * k >= 75 * (na.n + nb.n - k)),
e as (select a, b from l union all select b, a from l),
r(rid, reached) as (
  select rid, rid from d
  union
  select r.rid, e.b from r join e on r.reached = e.a),
c as (select r.rid, min(d.doc_id) as component_id from r join d on d.rid = r.reached group by r.rid)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id
from d join c using (rid) left join n using (rid)
"""
