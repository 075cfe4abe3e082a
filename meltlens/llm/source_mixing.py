"""Operator 13 - mixing sources to target weights by Sainte-Lague apportionment.

Targets: sources share all words by weight; a target stops at ``MAX_REPEATS``
times its source's words, and the excess is shared again by weight until none is
above.  In the order of capacity per weight, the sources that stop are a prefix,
so running totals give all targets at once.

Quotas: words are handed out in equal blocks of ``BLOCK_WORDS``.  A block goes
to the source with the highest quotient target / (2 s + 1), s being the blocks it
has; the blocks of a source go to its shards in the same way, by shard size.
Only quotients near the last one that gets a block are compared: with n parties
and Q blocks it lies within n / 2Q of the mean price of a block, a range that
holds about 2 n quotients.  The rest is a division.  Sources that reach their
cap give all words MAX_REPEATS times and take no part.

Selection: a shard is a hashed part of a source of about ``SHARD_WORDS`` words.
Its documents in the order of their ids as text are one run of words, cut into blocks.  A quota of
more than the whole run takes the run once (or twice), and the rest are the
whole blocks with the smallest seeded keys, each once, so no word is taken more
than MAX_REPEATS times.  Hashes and keys depend on ids, sizes and the seed only.

Defined results: a null text has no words; null sources come last in the order
of weights; a null id is an id; repeated rows are documents each; sources
without words have target 0; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordered import running_totals
from .common import attach_by_key, key_of, stored, table

WEIGHTS = [1, 2, 3]
MAX_REPEATS = 3
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 18
SEED = 13
#: A prime above 2^32 - 1's range of keys and a factor that scatters consecutive blocks over it.
PRIME, FACTOR = 4_294_967_291, 2_654_435_761


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hashed(text: Column) -> Column:
    """32 bits of a string's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: list[int], repeats: int) -> DataFrame:
    """``sources(key, words)`` with capped, target and open_words, the words of all targets that do not stop."""
    nulls_last = sources.select("*", (F.col("key") == "-").alias("none"))
    places = running_totals(nulls_last, [], ["none", "key"], {"place": F.lit(1).cast("long")}).drop("none")
    weighted = places.select("key", "words", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1)
                                                          .cast("int")).cast("long").alias("weight"))
    ratio = weighted.withColumn("ratio", F.col("words") * float(repeats) / F.col("weight"))
    summed = running_totals(ratio, [], ["ratio", "key"], {"words_to": F.col("words"), "weight_to": F.col("weight")})
    total = summed.agg(F.sum("words").alias("all_words"), F.sum("weight").alias("all_weight"))
    # what is left for a source and those after it when all before it stop at their caps
    left = F.col("all_words") - repeats * (F.col("words_to") - F.col("words"))
    left_weight = F.col("all_weight") - (F.col("weight_to") - F.col("weight"))
    judged = summed.crossJoin(F.broadcast(total)).select(
        "*", (F.col("ratio") * left_weight <= left).alias("capped"))
    # the first source that does not stop sets the share of all after it
    open_ = judged.agg(F.sum(F.when(F.col("capped"), F.col("words") * repeats).otherwise(0)).alias("given"),
                       F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("open_weight"))
    share = (F.col("all_words") - F.col("given")).cast("double") * F.col("weight") / F.col("open_weight")
    return judged.crossJoin(F.broadcast(open_)).select(
        "key", "words", "capped", F.when(F.col("capped"), (F.col("words") * repeats).cast("double")).otherwise(share).alias("target"),
        (F.col("all_words") - F.col("given")).alias("open_words"))


def sainte_lague(parties: DataFrame, group: str, party: str, votes: str, seats: str) -> DataFrame:
    """Columns group, party, quota: the seats of each group handed to its parties by highest quotients.

    ``seats`` is a column of ``parties`` that is constant within a group.  Seat s of a party costs
    (s + 0.5) / votes; the seats with the lowest costs are given, equal costs in the order of parties.
    Parties without votes get none."""
    ours = parties.select(F.col(group).alias("g"), F.col(party).alias("p"), F.col(votes).cast("double").alias("v"), F.col(seats).alias("q"))
    sums = ours.where("v > 0").groupBy("g").agg(F.sum("v").alias("all_v"), F.count("*").alias("n"))
    within = attach_by_key(ours.where("v > 0 and q > 0"), sums, "g", F.col("p"))
    fair = F.col("q") * F.col("v") / F.col("all_v")
    slack = (F.col("n") / 2 + 1) / F.col("q")
    first = F.floor(F.greatest(fair * (1 - slack) + 0.5, F.lit(0.0))).cast("long")
    last = F.floor(fair * (1 + slack) + 0.5).cast("long")
    ranged = stored(within.select("g", "p", "v", "q", first.alias("first"), last.alias("last")), "seats")
    given = ranged.groupBy("g").agg(F.sum("first").alias("given"))
    # about 2 n rows for n parties
    near = (ranged.where(F.col("last") > F.col("first"))
            .select("g", "p", "v", "q", F.explode(F.sequence("first", F.col("last") - 1)).alias("seat"))
            .select("g", "p", "q", ((F.col("seat") + 0.5) / F.col("v")).alias("cost"), "seat"))
    ranked = running_totals(near, ["g"], ["cost", "p", "seat"], {"rank": F.lit(1).cast("long")})
    won = (attach_by_key(ranked, given, "g", F.col("p")).where(F.col("rank") <= F.col("q") - F.col("given"))
           .groupBy("g", "p").agg(F.count("*").alias("more")))
    quotas = ranged.join(won, ["g", "p"], "left").select("g", "p", (F.col("first") + F.coalesce("more", F.lit(0))).alias("quota"))
    return quotas.select(F.col("g").alias(group), F.col("p").alias(party), "quota")


def taken_until(words: int, quota: int, capped: bool, seed: int, block: int, repeats: int) -> tuple[int, np.ndarray]:
    """How often the whole run of a shard is taken, and the words of its selected blocks before each block's start."""
    blocks = -(-words // block)
    if capped or not words:
        return (repeats if capped else 0), np.zeros(blocks + 1, dtype=np.int64)
    rounds = min(quota * block // words, repeats)
    rest = 0 if rounds == repeats else (quota * block - rounds * words + block // 2) // block
    keys = ((np.arange(blocks, dtype=np.uint64) + np.uint64(seed)) * np.uint64(FACTOR)) % np.uint64(PRIME)
    chosen = np.zeros(blocks, dtype=np.int64)
    if words % block:
        keys[-1] = PRIME  # the short block comes last
    chosen[np.argsort(keys)[:rest]] = block
    chosen[-1] = min(chosen[-1], words - (blocks - 1) * block)
    return rounds, np.concatenate([[0], np.cumsum(chosen)])


def select_words(sizes: np.ndarray, quota: int, capped: bool, seed: int, block: int, repeats: int) -> np.ndarray:
    """Words taken from each document of a shard, in the shard's order."""
    ends = np.cumsum(sizes)
    words = int(ends[-1]) if len(ends) else 0
    rounds, before = taken_until(words, quota, capped, seed, block, repeats)
    at = np.concatenate([[0], ends])
    whole, part = at // block, at % block
    size_of = np.append(np.diff(before), 0)
    until = before[whole] + np.minimum(part, size_of[whole])
    return rounds * sizes + np.diff(until)


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: list[int] | None = None, repeats: int = MAX_REPEATS, block: int = BLOCK_WORDS,
                shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """Columns: id, size, source_size, target, taken - one row per row of ``df``."""
    docs = stored(df.select(F.col(id_col).alias("id"), key_of(F.col(source_col)).alias("key"), word_count(F.col(text_col)).alias("size")),
                  "sizes")
    sources = stored(source_targets(docs.groupBy("key").agg(F.sum("size").alias("words")), weights or WEIGHTS, repeats), "targets")
    blocks = F.floor(F.col("open_words") / block + 0.5).cast("long")
    seats = sainte_lague(sources.where("not capped").select(F.lit("").alias("all"), "key", "target", blocks.alias("blocks")),
                         "all", "key", "target", "blocks").drop("all")
    parts = F.greatest(F.ceil(F.col("words") / shard_words), F.lit(1)).cast("long").alias("shards")
    known = stored(sources.join(seats, "key", "left").select("key", "words", "target", "capped", F.coalesce("quota", F.lit(0)).alias("seats"),
                                                              parts), "sources")
    salt = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size").cast("string"))
    dealt = attach_by_key(docs, known.select("key", "words", "target", "shards"), "key", F.col("id")).withColumn(
        "shard", F.pmod(hashed(salt), F.col("shards")))
    totals = attach_by_key(dealt.groupBy("key", "shard").agg(F.sum("size").alias("shard_words")),
                           known.select("key", "seats", "capped"), "key", F.col("shard"))
    totals = stored(totals, "shards")
    quotas = totals.join(sainte_lague(totals, "key", "shard", "shard_words", "seats"), ["key", "shard"], "left").select(
        "key", "shard", "capped", F.coalesce("quota", F.lit(0)).alias("quota"),
        hashed(F.concat_ws(":", F.lit(str(seed)), "key", "shard")).alias("start"))
    kind = dict(docs.dtypes)["id"]

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "size"])
        first = rows.iloc[0]
        sizes = rows["size"].to_numpy(dtype=np.int64)
        taken = select_words(sizes, int(first["quota"]), bool(first["capped"]), int(first["start"]), block, repeats)
        return pd.DataFrame({"id": rows["id"], "size": sizes, "words": rows["words"], "target": rows["target"], "taken": taken})

    # a shard is a bounded run of words; documents without words are in none
    text_ids = dealt.where("size > 0").join(quotas, ["key", "shard"]).withColumn("id", F.col("id").cast("string"))
    chosen = text_ids.groupBy("key", "shard").applyInPandas(select, "id string, size long, words long, target double, taken long")
    empty = dealt.where("size = 0").select(F.col("id").cast("string").alias("id"), "size", "words", "target",
                                           F.lit(0).cast("long").alias("taken"))
    return chosen.unionByName(empty).select(F.col("id").cast(kind).alias(id_col), "size", F.col("words").alias("source_size"),
                                            "target", "taken")


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
with d as (
  select row_number() over () as rid, doc_id, case when source is null then '-' else '=' || source end as key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size
  from documents),
s as (
  select key, words, (row_number() over (order by key = '-', encode(key)) - 1) % {len(WEIGHTS)} as place
  from (select key, sum(size)::bigint as words from d group by key)),
w as (select key, words, {WEIGHTS}[place + 1] as weight, words * {MAX_REPEATS}e0 / {WEIGHTS}[place + 1] as ratio from s),
r as (
  select *, sum(words) over ()::bigint as all_words, sum(weight) over ()::bigint - sum(weight) over o::bigint + weight as left_weight,
         sum(words) over ()::bigint - {MAX_REPEATS} * (sum(words) over o::bigint - words) as left_words
  from w window o as (order by ratio, encode(key) rows unbounded preceding)),
c as (select *, ratio * left_weight <= left_words as capped from r),
t as (
  select *, all_words - (select coalesce(sum({MAX_REPEATS} * words) filter (capped), 0)::bigint from c) as open_words,
         (select sum(weight) filter (not capped)::bigint from c) as open_weight
  from c),
g as (
  select key, words, capped, greatest(ceil(words / {SHARD_WORDS}), 1)::bigint as shards,
         case when capped then ({MAX_REPEATS} * words)::double else open_words::double * weight / open_weight end as target,
         floor(open_words / {BLOCK_WORDS} + 0.5)::bigint as blocks
  from t),
q as (
  select key, count(*) as seats
  from (select key, blocks, row_number() over (order by (seat + 0.5e0) / target, encode(key), seat) as rank
        from (select key, target, blocks, unnest(range(blocks)) as seat from g where not capped and target > 0))
  where rank <= blocks group by key),
e as (
  select rid, doc_id, d.key, size, words, target, capped, coalesce(seats, 0) as seats,
         ('0x' || md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || size)[1:8])::bigint % shards as shard
  from d join g using (key) left join q using (key)),
h as (
  select key, shard, any_value(capped) as capped, any_value(seats) as seats, sum(size)::bigint as words,
         ('0x' || md5('{SEED}:' || key || ':' || shard)[1:8])::hugeint as start
  from e group by key, shard),
k as (
  select key, shard, count(*) as quota
  from (select key, shard, seats, row_number() over (partition by key order by (seat + 0.5e0) / words, shard, seat) as rank
        from (select key, shard, words, seats, unnest(range(seats)) as seat from h where words > 0))
  where rank <= seats group by key, shard),
m as (
  select key, shard, capped, words, start, ceil(words / {BLOCK_WORDS})::bigint as n,
         case when capped then {MAX_REPEATS} else least(coalesce(quota, 0) * {BLOCK_WORDS} // words, {MAX_REPEATS}) end as rounds,
         coalesce(quota, 0) * {BLOCK_WORDS} as wanted
  from h left join k using (key, shard) where words > 0),
b as (
  select key, shard, b, rest,
         row_number() over (partition by key, shard order by (b + 1) * {BLOCK_WORDS} > words, ((b + start) * {FACTOR}) % {PRIME}) as rank
  from (select *, case when rounds = {MAX_REPEATS} then 0 else (wanted - rounds * words + {BLOCK_WORDS // 2}) // {BLOCK_WORDS} end as rest,
               unnest(range(n)) as b from m)),
p as (
  select *, sum(size) over (partition by key, shard order by doc_id::varchar nulls last, size, rid)::bigint as stop from e),
x as (
  select rid, sum(least(stop, (b + 1) * {BLOCK_WORDS}) - greatest(stop - size, b * {BLOCK_WORDS}))::bigint as part
  from p join b using (key, shard)
  where rank <= rest and b * {BLOCK_WORDS} < stop and (b + 1) * {BLOCK_WORDS} > stop - size group by rid)
select doc_id, size, p.words as source_size, target, case when size = 0 then 0 else rounds * size + coalesce(part, 0) end as taken
from p left join m using (key, shard) left join x using (rid)
"""
