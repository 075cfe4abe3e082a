"""Operator 2 - chat formatting by quotation linking.

A message is split into its own text and quoted passages (lines led by ``>``,
nested levels by several).  Both are normalised (case, white space) and cut
into units: lines, the sentences of each line, and the sentences of the text
without its line breaks.  Their hashes link a passage to the messages that wrote
them: the origin of a passage is the earlier message of the conversation that
holds most of its units (ties: the one that wrote more of them first, then the
later one).  A passage of which no unit is known (a part of a sentence) is linked
by its windows of ``WINDOW`` words (fewer, if it is shorter) to the earlier
message that holds most of them, at least half.  The parent of a message is the
origin of its outermost quoted level that has one.  Parents come before their
replies, so threads are trees; their roots are found by pointer jumping.  The
result is every message without the quotes that have an origin, in reply order by
(conversation, thread_turn, turn).  A passage without origin (a prompt of a shell,
a comparison, a quote from elsewhere) stays in the text as it was written.

First writers are joined on a unique key.  They settle a passage if one of them
has all its units.  Otherwise the best first writer has f of u units, so a better
message holds one of the u - f + 1 rarest ones: only their holders are candidates,
and common units multiply no rows unless all of a passage is common.

Defined results: null text is an empty message; a null conversation or turn is
not linked and keep their whole text; rows that repeat a (conversation, turn) share
the link; a passage repeated in a message counts each time in ``n_passages`` and goes
each time if it has an origin; a message that quotes nothing known starts its own thread; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_batches, stored, table

QUOTE = re.compile(r"\s*((?:>[ \t]?)+)(.*)", re.DOTALL)
ATTRIBUTION = re.compile(r"(?:on\b.{0,200}\bwrote|.{0,100}\bwrote|.{0,100}\bsaid)\s*:\s*", re.IGNORECASE | re.DOTALL)
_STOPS = ".!?\u3002\uff01\uff1f\uff0e\uff61\u2026\u061f\u06d4\u0964\u0965\u1362\u1367\u104b\u17d4"
SENTENCE = re.compile(f"[^{_STOPS}]+[{_STOPS}]*")
#: A word, or one character of a script written without spaces.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(f"[{_UNSPACED}]|[^\\W{_UNSPACED}]+")
#: Words of the longest window by which a part of a sentence is found.
WINDOW = 5


class Part(NamedTuple):
    """A run of lines of a message: own text (level 0) or a quoted passage of one level."""

    level: int
    raw: str
    text: str


def split_quotes(message: str | None) -> list[Part]:
    """The parts of a message in order; an attribution line goes with its quote."""
    parts: list[tuple[int, list[str], list[str]]] = []
    for line in (message or "").split("\n"):
        found = QUOTE.fullmatch(line)
        level = found[1].count(">") if found else 0
        if not parts or parts[-1][0] != level:
            led = []
            if level and parts and not parts[-1][0] and ATTRIBUTION.fullmatch(parts[-1][1][-1]):
                led = [parts[-1][1].pop()]
                parts[-1][2].pop()
                if not parts[-1][1]:
                    parts.pop()
            parts.append((level, led, []))
        parts[-1][1].append(line)
        parts[-1][2].append(found[2] if found else line)
    return [Part(level, "\n".join(raw), "\n".join(text)) for level, raw, text in parts]


def own_text(parts: list[Part]) -> str:
    return "\n".join(p.text for p in parts if not p.level).strip()


def signed_hash(text: str) -> int:
    return (xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) ^ (1 << 63)) - (1 << 63)


def unit_hashes(text: str) -> list[int]:
    """Signed 64-bit hashes of the normalised lines and sentences of a text, each once."""
    lines = [" ".join(line.split()) for line in text.lower().splitlines()]
    found = dict.fromkeys(s.strip() for part in (" ".join(lines), *lines) for s in SENTENCE.findall(part))
    found.update(dict.fromkeys(lines))
    return [signed_hash(s) for s in found if s]


def window_hashes(text: str, lengths: Iterable[int] | None = None) -> list[int]:
    """Hashes of the word windows of these lengths; by default those by which a passage is looked up."""
    words = WORD.findall(text.lower())
    lengths = [min(WINDOW, len(words))] if lengths is None else lengths
    return [signed_hash(w) for w in dict.fromkeys(
        f"{n} " + " ".join(words[k:k + n]) for n in lengths if n for k in range(len(words) - n + 1))]


def parse_messages(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Columns conv, turn, role, text (own), parts (passage, raw), said (hashes), quoted (passage, level, hashes, windows).

    A passage is named by the hash of its level and text; own parts have none."""
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                     F.col(text_col).alias("raw"))
    kinds = dict(rows.dtypes)

    def name(part: Part) -> int | None:
        return signed_hash(f"{part.level} {part.text}") if part.level else None

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in row_batches(batches, 2000):
            split = [split_quotes(t) for t in batch["raw"]]
            own = [own_text(parts) for parts in split]
            out = batch[["conv", "turn", "role"]].astype(object).where(batch[["conv", "turn", "role"]].notna(), None)
            out["text"] = own
            out["parts"] = [[{"passage": name(p), "raw": p.raw} for p in parts] for parts in split]
            out["said"] = [unit_hashes(t) for t in own]
            out["quoted"] = [[{"passage": name(p), "level": p.level, "hashes": unit_hashes(p.text), "windows": window_hashes(p.text)}
                              for p in {name(p): p for p in parts if p.level}.values()] for parts in split]
            yield out

    return rows.mapInPandas(parse, (
        f"conv {kinds['conv']}, turn {kinds['turn']}, role {kinds['role']}, text string, "
        "parts array<struct<passage:long,raw:string>>, said array<long>, "
        "quoted array<struct<passage:long,level:int,hashes:array<long>,windows:array<long>>>"))


_PASSAGE = ["conv", "turn", "passage", "level"]


def most_held(quoted: DataFrame, said: DataFrame, share: float = 0.0) -> DataFrame:
    """Columns of a passage and origin, of ``quoted(passage's columns, hash)`` and ``said(conv, turn, hash)``.

    Origins hold at least ``share`` of the passage's hashes.
    """
    said = stored(said.join(quoted.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
                  .select("conv", "hash", F.col("turn").alias("origin")).distinct(), "said")
    held = said.groupBy("conv", "hash").agg(F.min("origin").alias("first"), F.count("*").alias("holders"))
    sizes = quoted.groupBy(_PASSAGE).agg(F.count("*").alias("size"))
    units = quoted.join(held, ["conv", "hash"]).where("first < turn")
    best = (units.groupBy(*_PASSAGE, "first").agg(F.count("*").alias("n")).groupBy(_PASSAGE)
            .agg(F.sum("n").alias("known"), F.max("n").alias("best"), F.max_by("first", F.struct("n", "first")).alias("origin")))
    settled = best.where("best = known").select(*_PASSAGE, "origin", F.col("best").alias("n"))
    rare = F.row_number().over(Window.partitionBy(_PASSAGE).orderBy("holders", "hash"))  # bounded by the passage's length
    open_units = stored(units.join(best.where("best < known").drop("origin"), _PASSAGE).withColumn("rare", rare), "units")
    candidates = (open_units.where("rare <= known - best + 1").join(said, ["conv", "hash"]).where("origin < turn")
                  .select(*_PASSAGE, "origin").distinct())
    votes = (candidates.join(open_units.select(*_PASSAGE, "hash", "first"), _PASSAGE).join(said, ["conv", "hash", "origin"])
             .groupBy(*_PASSAGE, "origin").agg(F.count("*").alias("n"), F.count(F.when(F.col("first") == F.col("origin"), 1)).alias("firsts")))
    voted = votes.groupBy(_PASSAGE).agg(F.max_by("origin", F.struct("n", "firsts", "origin")).alias("origin"), F.max("n").alias("n"))
    return (settled.unionByName(voted).join(sizes, _PASSAGE).where(F.col("n") >= share * F.col("size"))
            .select(*_PASSAGE, "origin"))


def passage_origins(messages: DataFrame) -> DataFrame:
    """Columns conv, turn, passage, level, origin: the earlier message each quoted passage comes from."""
    named = messages.where("conv is not null and turn is not null")
    passages = stored(named.where(F.size("quoted") > 0).select("conv", "turn", F.explode("quoted").alias("q"))
                      .select("conv", "turn", "q.*"), "passages")
    hashes = lambda rows, name: rows.select(*_PASSAGE, F.explode(name).alias("hash")).distinct()
    whole = stored(most_held(hashes(passages, "hashes"), named.select("conv", "turn", F.explode("said").alias("hash"))), "origins")
    rest = passages.join(whole, _PASSAGE, "left_anti")
    if rest.isEmpty():
        return whole

    @F.pandas_udf("array<long>")
    def windows(texts: pd.Series) -> pd.Series:
        return pd.Series([window_hashes(t, range(1, WINDOW + 1)) for t in texts], dtype=object)

    asked = named.join(rest.select("conv").distinct(), "conv", "left_semi").where("text <> ''")
    parts = most_held(hashes(rest, "windows"), asked.select("conv", "turn", F.explode(windows("text")).alias("hash")), 0.5)
    return whole.unionByName(parts)


def thread_roots(parents: DataFrame) -> DataFrame:
    """``parents(conv, turn, parent)`` with ``root``, the first message up the chain (pointer jumping)."""
    known = stored(parents.withColumn("root", F.col("parent")), "threads")
    while True:
        up = known.select("conv", F.col("turn").alias("root"), F.col("root").alias("above"))
        jumped = known.join(up, ["conv", "root"], "left")
        moved = jumped.select("conv", "turn", "parent", F.coalesce("above", "root").alias("root"),
                              F.col("above").isNotNull().alias("moved"))
        known = stored(moved, "threads")
        if known.where("moved").isEmpty():
            return known.drop("moved")


def link_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                       text_col: str = "text") -> DataFrame:
    """Columns: conversation, turn, role, parent_turn, thread_turn, n_passages, n_linked, text - one row per message.

    ``n_passages`` counts the quoted passages of a message, ``n_linked`` those with an origin, which ``text`` is without.
    """
    messages = parse_messages(df, conv_col, turn_col, role_col, text_col)
    origins = stored(passage_origins(messages), "links")
    parents = origins.groupBy("conv", "turn").agg(
        F.max_by("origin", F.struct(-F.col("level"), F.col("origin"))).alias("parent"),
        F.collect_set("passage").alias("linked"))  # bounded by the message
    roots = thread_roots(parents.drop("linked")).join(parents.select("conv", "turn", "linked"), ["conv", "turn"])
    out = messages.join(roots, ["conv", "turn"], "left")
    linked = lambda p: p["passage"].isNotNull() & F.coalesce(F.array_contains("linked", p["passage"]), F.lit(False))
    left = F.transform(F.filter("parts", lambda p: ~linked(p)), lambda p: p["raw"])
    text = F.regexp_replace(F.array_join(left, "\n"), r"(?U)^\s++|(?<!\s)\s++$", "")
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col),
                      F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("thread_turn"),
                      F.size(F.filter("parts", lambda p: p["passage"].isNotNull())).cast("long").alias("n_passages"),
                      F.size(F.filter("parts", linked)).cast("long").alias("n_linked"), text.alias(text_col))


def op2_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_conversations(table(spark, sf_dir, "conversations"))
