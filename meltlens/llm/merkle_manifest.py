"""Operator 11 - Merkle dataset manifest by butterfly exchange.

Every row is a leaf (SHA-256 of its fields), every group of rows (a source) is a
tree of fanout 3 over its leaves in id order, and the groups' roots are the
leaves of one upper tree.  Leaves are dealt into aligned blocks of 3^6; a block
is one row and hashes its own subtree.

Blocks then exchange as in a butterfly network.  In round r the three blocks
that differ only in base-3 digit r of their number form a group and swap the
roots of their subtrees (of 3^r blocks each).  Each hashes the three together
itself, so after the round it holds the next ancestor and the siblings on the
way there: its upper proof grows round by round and nothing is sent down again.
At the ragged end, a cell of the exchange that lacks members lets those it has
stand in for them in the next round, so every exchange has at most three members
and no block is asked by many.  A tree of n blocks takes ceil(log3 n) rounds
over narrow rows, at most three times as many as there are blocks.

Defined results: a null field is hashed as ``-``; null ids come first; rows of
equal ids stand in the order of their leaves; repeated rows are leaves each;
null groups come first; extra columns are ignored; an empty table gives an empty
result.  Texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach_by_key, key_of, stored, table

FANOUT = 3
BLOCK_LEVELS = 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: One entry per level: the hashes of the run's other nodes before and after the own one.
PATH = "array<struct<left:string,right:string>>"


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(fields: list[Column]) -> Column:
    """Each field as ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
                             for v in values]), 256)


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Stored ``leaves`` (with ``key``) with ``at``, the place within the key from 0, and ``n``, the key's rows.

    Rows are range-partitioned, so a key of any size is spread; only a count per key and
    partition is needed to place them."""
    ordered = leaves.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    rows = stored(ordered.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "leaves")
    parts = rows.groupBy("key", "__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy("key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # a key has at most one row per partition here
    bases = parts.select("key", "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__base"),
                         F.sum("__n").over(Window.partitionBy("key")).alias("n"))
    placed = rows.join(bases, ["key", "__part"]).withColumn("at", F.col("__base") + F.col("__row"))
    return placed.drop("__part", "__row", "__base")


def hash_runs(nodes: list[str], fanout: int) -> list[str]:
    return [sha256("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]


def depth(n: int, fanout: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while fanout**levels < n:
        levels += 1
    return levels


def subtree(leaves: list[str], levels: int, fanout: int) -> list[list[str]]:
    """All levels of a block's subtree, leaves first."""
    rows = [list(leaves)]
    for _ in range(levels):
        rows.append(hash_runs(rows[-1], fanout))
    return rows


def steps(rows: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """(left, right) siblings of leaf ``at`` on every level of a subtree."""
    path = []
    for nodes in rows[:-1]:
        first = at - at % fanout
        path.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + fanout])))
        at //= fanout
    return path


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = sha256(left + leaf + right)
    return leaf


def cut_blocks(leaves: DataFrame, columns: list[str], fanout: int, levels: int) -> DataFrame:
    """One stored row per aligned block: key, block, n (leaves of the key), arrays of ``columns``, node (its root)."""
    size = fanout**levels
    items = F.sort_array(F.collect_list(F.struct("at", *columns)))  # at most ``size``
    blocks = (leaves.withColumn("block", F.floor(F.col("at") / size)).groupBy("key", "block")
              .agg(F.first("n").alias("n"), items.alias("items")))

    @F.pandas_udf("string")
    def root(hashes: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([subtree(h, min(levels, depth(k, fanout)), fanout)[-1][0] for h, k in zip(hashes, n)], dtype=object)

    arrays = blocks.select("key", "block", "n", *[F.col(f"items.{c}").alias(c) for c in columns])
    return stored(arrays.withColumn("node", root("leaf", "n")), "blocks")


def swap_roots(nodes: DataFrame, width: int, fanout: int) -> DataFrame:
    """One round: cells of blocks that differ in one digit hash the roots of their subtrees of ``width`` blocks together.

    Columns key, block, blocks, node, path; ``path`` is null for a block that only stands in for a missing one."""
    digit = (F.floor(F.col("block") / width) % fanout).cast("int")
    cells = nodes.groupBy("key", "blocks", F.floor(F.col("block") / (width * fanout)).alias("cell"),
                          (F.col("block") % width).alias("column"))
    members = F.sort_array(F.collect_list(F.struct(digit.alias("digit"), "node", "path")))  # at most ``fanout``
    met = cells.agg(members.alias("members")).withColumn("up", F.sha2(F.array_join("members.node", ""), 256))
    dealt = met.select("*", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("digit"))
    own = F.get(F.filter("members", lambda m: m["digit"] == F.col("digit")), F.lit(0))["path"]
    side = lambda keep: F.array_join(F.transform(F.filter("members", keep), lambda m: m["node"]), "")
    step = F.struct(side(lambda m: m["digit"] < F.col("digit")).alias("left"), side(lambda m: m["digit"] > F.col("digit")).alias("right"))
    return dealt.select("key", (F.col("cell") * (width * fanout) + F.col("digit") * width + F.col("column")).alias("block"),
                        "blocks", F.col("up").alias("node"), F.concat(own, F.array(step)).alias("path"))


def exchange(blocks: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Columns key, block, top (the root of the key's tree), path (from the block's root up to it)."""
    nodes = blocks.select("key", "block", F.ceil(F.col("n") / fanout**levels).alias("blocks"), "node",
                          F.array().cast(PATH).alias("path"))
    rounds = depth(blocks.agg(F.max(F.ceil(F.col("n") / fanout**levels))).head()[0] or 0, fanout)
    done = [nodes.where("blocks = 1")]
    for r in range(rounds):
        width = fanout**r
        swapped = stored(swap_roots(nodes.where(F.col("blocks") > width), width, fanout), f"exchange-{r}")
        done.append(swapped.where((F.col("blocks") <= width * fanout) & F.col("path").isNotNull()))
        nodes = swapped
    tops = done[0]
    for more in done[1:]:
        tops = tops.unionByName(more)
    return tops.select("key", "block", F.col("node").alias("top"), "path")


def group_paths(tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Columns key, upper (path from the group's root to the manifest's), root: the tree over all groups' roots."""
    roots = tops.where("block = 0").select(F.lit("").alias("key"), F.col("key").alias("group"), F.col("top").alias("leaf"))
    blocks = cut_blocks(numbered(stored(roots, "roots"), ["group"]), ["group", "leaf"], fanout, levels)
    joined = blocks.join(exchange(blocks, fanout, levels), ["key", "block"]).select("group", "leaf", "n", "top", "path")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for groups, leaves, n, top, path in zip(batch["group"], batch["leaf"], batch["n"], batch["top"], batch["path"]):
                rows = subtree(leaves, min(levels, depth(n, fanout)), fanout)
                above = [{"left": s["left"], "right": s["right"]} for s in path]
                upper = [[{"left": a, "right": b} for a, b in steps(rows, i, fanout)] + above for i in range(len(leaves))]
                yield pd.DataFrame({"key": groups, "upper": upper, "root": top})

    return stored(joined.mapInPandas(spread, f"key string, upper {PATH}, root string"), "group-paths")


def merkle_manifest(df: DataFrame, fields: list[str] | None = None, group_col: str = "source", id_col: str = "doc_id",
                    tampered: dict[str, Column] | None = None, with_proofs: bool = False, fanout: int = FANOUT,
                    levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row of ``df``: id, leaf, subroot, root, proof_sha256, folded_root, verified and, on request, proof.

    ``tampered`` replaces fields by other values: ``folded_root`` is folded from the leaf of these
    along the proof of the original rows, and ``verified`` tells whether it is the root.
    ``proof`` is the path as (left, right) siblings per level."""
    fields = fields or FIELDS
    now = [(tampered or {}).get(f, F.col(f)) for f in fields]
    changed = F.lit(False)
    for f in tampered or {}:
        changed = changed | ~tampered[f].eqNullSafe(F.col(f))
    leaves = stored(df.select(
        key_of(F.col(group_col)).alias("key"), F.col(id_col).alias("id"), leaf_hash([F.col(f) for f in fields]).alias("leaf"),
        F.when(changed, leaf_hash(now)).alias("other"), F.monotonically_increasing_id().alias("__tie")), "hashes")
    kind = dict(leaves.dtypes)["id"]
    blocks = cut_blocks(numbered(leaves, ["id", "leaf", "__tie"]).drop("__tie"), ["id", "leaf", "other"], fanout, levels)
    tops = exchange(blocks, fanout, levels)
    joined = attach_by_key(blocks.join(tops, ["key", "block"]), group_paths(tops, fanout, levels), "key", F.col("block"))

    def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, leaves, others, n, top, path, upper, root in zip(*[batch[c] for c in columns]):
                rows = subtree(leaves, min(levels, depth(n, fanout)), fanout)
                above = [(s["left"], s["right"]) for s in (*path, *upper)]
                out = []
                for i, (doc, leaf, other) in enumerate(zip(ids, leaves, others)):
                    whole = steps(rows, i, fanout) + above
                    folded = fold(other or leaf, whole)
                    proof = [{"left": a, "right": b} for a, b in whole] if with_proofs else None
                    out.append((doc, leaf, top, root, sha256("".join(a + b for a, b in whole)), folded, folded == root, proof))
                frame = pd.DataFrame(out, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"])
                frame["id"] = frame["id"].astype(object).where(frame["id"].notna(), None)
                yield frame if with_proofs else frame.drop(columns="proof")

    columns = ["id", "leaf", "other", "n", "top", "path", "upper", "root"]
    schema = (f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
              + f", proof {PATH}" * with_proofs)
    return joined.select(*columns).mapInPandas(prove, schema).withColumnRenamed("id", id_col)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering deletes the line feeds of every text whose id has an even CRC-32."""
    text = F.col("text")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle_manifest(table(spark, sf_dir, "documents"),
                           tampered={"text": F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)})


#: CRC-32 of a string's bytes, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(1, strlen(doc_id::varchar) + 1),
      lambda i: ascii(substr(doc_id::varchar, i::int, 1))::bigint)), lambda c, b: list_reduce(list_concat([xor(c, b)],
      [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _leaf_sql(text: str) -> str:
    fields = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({f})::varchar || ':' || {f}, '-')" for f in fields) + "))"


OP11_SQL = f"""
with recursive d as (
  select row_number() over () as rid, doc_id, source, {_leaf_sql('text')} as leaf,
         {_leaf_sql(f"(case when {_CRC} % 2 = 0 then replace(text, chr(10), '') else text end)")} as other
  from documents),
p as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf, rid) - 1 as pos,
         dense_rank() over (order by source is not null, encode(source)) - 1 as src
  from d),
t as (
  select 0 as level, src, pos as i, leaf as h, count(*) over (partition by src) as n from p
  union all
  select level + 1, src, i // 3, sha256(string_agg(h, '' order by i)), (max(n) + 2) // 3
  from t where n > 1 group by level, src, i // 3),
u as (
  select 0 as level, src as i, h, count(*) over () as n from t where n = 1
  union all
  select level + 1, i // 3, sha256(string_agg(h, '' order by i)), (max(n) + 2) // 3 from u where n > 1 group by level, i // 3),
w as (
  select rid, src, doc_id, leaf, other as h, pos as i, 0 as level, '' as proof from p
  union all
  select rid, src, doc_id, leaf,
         sha256((select coalesce(string_agg(t.h, '' order by t.i), '') from t where t.src = w.src and t.level = w.level and t.i // 3 = w.i // 3 and t.i < w.i)
                || h || (select coalesce(string_agg(t.h, '' order by t.i), '') from t where t.src = w.src and t.level = w.level and t.i // 3 = w.i // 3 and t.i > w.i)),
         i // 3, level + 1,
         proof || (select coalesce(string_agg(t.h, '' order by t.i), '') from t where t.src = w.src and t.level = w.level and t.i // 3 = w.i // 3 and t.i <> w.i)
  from w where level < (select max(level) from t where t.src = w.src)),
s as (
  select w.* from w join (select src, max(level) as top from t group by src) m on w.src = m.src and w.level = m.top),
x as (
  select rid, src, doc_id, leaf, h, src as i, 0 as level, proof from s
  union all
  select rid, src, doc_id, leaf,
         sha256((select coalesce(string_agg(u.h, '' order by u.i), '') from u where u.level = x.level and u.i // 3 = x.i // 3 and u.i < x.i)
                || h || (select coalesce(string_agg(u.h, '' order by u.i), '') from u where u.level = x.level and u.i // 3 = x.i // 3 and u.i > x.i)),
         i // 3, level + 1,
         proof || (select coalesce(string_agg(u.h, '' order by u.i), '') from u where u.level = x.level and u.i // 3 = x.i // 3 and u.i <> x.i)
  from x where level < (select max(level) from u))
select doc_id, leaf, t.h as subroot, (select h from u where n = 1) as root, sha256(proof) as proof_sha256, x.h as folded_root,
       x.h = (select h from u where n = 1) as verified
from x join t on t.src = x.src and t.n = 1 where x.level = (select max(level) from u)
"""
