"""Operator 6 - benchmark decontamination (DataFrame operations only).

Benchmark texts become windows of ``WINDOW`` consecutive normalised words (a
shorter item is one window).  Their 64-bit hashes are a broadcast hash set, behind
a check of its size.  Each document's word windows, of the lengths that the
benchmark has, are hashed in its own row and probed in the same stage; only those
whose hash is in the set go on, and each of them is verified by joining on the
window's words.  Of a set above the bound, the windows' hashes and positions (no
words) are shuffled to it, and the documents that they meet are verified likewise.

Defined results: a null text has no words; an item without words has no window;
repeated rows are judged each for itself; repeated items and windows count once
per item id; a null item id is never listed but its windows hit; extra columns
are ignored (``find_hits``) or carried (``remove_documents``, ``remove_spans``);
empty tables give an empty result or no hits.  Texts are never shortened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

WINDOW = 13
#: A document is contaminated when at least one word in this many is hit.
HIT_DIVISOR = 20
#: Distinct hashes of benchmark windows that are broadcast (16 bytes each in the set); more are joined by a shuffle.
MAX_SET_WINDOWS = 2_000_000
#: Windows whose words are broadcast to verify hits; texts whose ids are broadcast to drop their rows.
MAX_SHIPPED_WINDOWS, MAX_SHIPPED_TEXTS = 100_000, 500_000

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Normalised words; an empty array for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def window_rows(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns item, n (words of the window), words, h - one row per distinct window and item."""
    items = bench.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    n = F.least(F.size("w"), F.lit(WINDOW))
    rows = items.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("at"))
    words = F.slice("w", F.col("at"), F.col("n"))
    return rows.select("item", "n", F.array_join(words, " ").alias("words"), F.xxhash64(words).alias("h")).distinct()


def window_hashes(words: Column, lengths: list[int]) -> Column:
    """Hashes of the windows of all these lengths, one length after the other, each in the order of the words."""
    none = F.array().cast("array<bigint>")

    def of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.xxhash64(F.slice(words, at, n)))

    return F.concat(none, *map(of, lengths))


def window_at(place: Column, n_words: Column, lengths: list[int]) -> tuple[Column, Column]:
    """First word (from 0) and length of the window at a place of ``window_hashes``."""
    at, size = place, F.lit(None).cast("int")
    ends, end = [], F.lit(0)
    for n in lengths:
        ends.append((end, end + F.greatest(n_words - n + 1, F.lit(0)), n))
        end = ends[-1][1]
    for start, end, n in reversed(ends):
        at, size = F.when(place < end, place - start).otherwise(at), F.when(place < end, F.lit(n)).otherwise(size)
    return at.cast("int"), size


def probe(texts: DataFrame, kept: list[str], lengths: list[int], hashes: DataFrame, fits: bool) -> DataFrame:
    """Columns of ``kept``, at, n and words: a row per window whose hash is in the set, and one without a window for each text."""
    met = hashes.withColumn("met", F.lit(True))
    listed = texts.select(*kept, "w", window_hashes(F.col("w"), lengths).alias("hashes"))
    if fits:
        probed = (listed.select(*kept, "w", F.posexplode_outer("hashes").alias("place", "h"))
                  .join(F.broadcast(met), "h", "left").where("met or place is null or place = 0"))
    else:
        listed = stored(listed.drop("hashes"), "words")  # the row numbers stand still
        windows = listed.select("row", F.posexplode(window_hashes(F.col("w"), lengths)).alias("place", "h"))
        places = windows.join(met, "h").groupBy("row").agg(F.collect_list("place").alias("places"))  # bounded by the text
        probed = (listed.join(places, "row", "left").select(*kept, "w", F.explode_outer("places").alias("place"))
                  .withColumn("met", F.col("place").isNotNull()))
    at, n = window_at(F.col("place"), F.size("w"), lengths)
    return probed.select(*kept, F.when(F.col("met"), at).alias("at"), F.when(F.col("met"), n).alias("n"),
                         F.when(F.col("met"), F.array_join(F.slice("w", at + 1, n), " ")).alias("words"))


def find_hits(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: the columns of ``keep``, ``text_id`` (SHA-256 of the text), n_words, n_hit,
    hit_words (positions of the hit words) and items (sorted ids of the items with occurring windows)."""
    keep = keep or []
    text = F.col(text_col)
    docs_words = docs.select(
        F.monotonically_increasing_id().alias("row"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_id"),
        *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], words_of(text).alias("w"))
    kept = ["row", "text_id", *[f"keep_{i}" for i in range(len(keep))], "n_words"]
    docs_words = docs_words.withColumn("n_words", F.size("w").cast("long"))

    windows = stored(window_rows(bench, item_col, item_text_col), "windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most WINDOW rows
    hashes = windows.select("h").distinct()
    fits = hashes.count() <= MAX_SET_WINDOWS
    verify = windows.drop("h").withColumn("met", F.lit(True))
    if windows.count() <= MAX_SHIPPED_WINDOWS:
        verify = F.broadcast(verify)
    found = probe(docs_words, kept, lengths, hashes, fits).join(verify, ["n", "words"], "left")
    span = F.when(F.col("met"), F.struct("at", "n"))
    rows = found.groupBy(*kept).agg(F.collect_set(span).alias("spans"), F.collect_set("item").alias("items"))
    inside = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))
    hit = F.array_sort(F.array_distinct(inside))
    return rows.select(
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "text_id", "n_words",
        F.size(hit).cast("long").alias("n_hit"), hit.alias("hit_words"), F.sort_array("items").alias("items"))


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (HIT_DIVISOR * F.col("n_hit") >= F.col("n_words"))


def remove_documents(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
                     item_text_col: str = "text") -> DataFrame:
    """``docs`` (all its columns) without the contaminated rows."""
    bad = find_hits(docs, bench, text_col, item_col, item_text_col).where(is_contaminated()).select(
        F.col("text_id").alias("__text_id")).distinct()
    bad = stored(bad, "contaminated")
    if bad.count() <= MAX_SHIPPED_TEXTS:
        bad = F.broadcast(bad)
    named = docs.withColumn("__text_id", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return named.join(bad, "__text_id", "left_anti").select(*[F.col(c) for c in docs.columns])


def remove_spans(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """``docs`` (all its columns) with the hit words cut out; what stands between words stays."""
    hits = (find_hits(docs, bench, text_col, item_col, item_text_col).where("n_hit > 0")
            .groupBy("text_id").agg(F.first("hit_words").alias("__hit")).withColumnRenamed("text_id", "__text_id"))
    text = F.col(text_col)
    named = docs.withColumn("__text_id", F.sha2(F.coalesce(text, F.lit("")), 256)).join(hits, "__text_id", "left")
    # words and the stretches between them alternate; the k-th word is piece 2k or 2k + 1
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    named = named.withColumn("__pieces", F.when(F.col("__hit").isNotNull(), pieces))
    shift = F.when(F.col("__pieces")[0].rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 1).otherwise(0)
    named = named.withColumn("__drop", F.transform("__hit", lambda k: 2 * k + shift))
    left = F.filter("__pieces", lambda _, i: ~F.array_contains("__drop", i))
    named = named.withColumn(text_col, F.when(F.col("__hit").isNull(), text).otherwise(F.array_join(left, "")))
    return named.select(*[F.col(c) for c in docs.columns])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


OP6_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id::varchar as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bn as (select item, w, least(len(w), 13) as n from b where len(w) > 0),
bw as (
  select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as words
  from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from bn)),
ns as (select distinct n from bw),
dw as (
  select rid, n, i, array_to_string(w[i:i + n - 1], ' ') as words
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns where len(w) >= n)),
h as (select rid, dw.n, i, item from dw join bw on dw.n = bw.n and dw.words = bw.words),
hw as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from h) group by rid),
hi as (
  select rid, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct rid, item from h) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hw using (rid) left join hi using (rid)
"""
