"""Operator 10 - best-fit packing by exact complements.

Documents become token pieces of at most ``CAPACITY`` ids, written once to the
shared folder.  Packing needs only how many pieces there are of each length, a
table of at most ``CAPACITY`` rows.  From it a plan is made: the longest piece
left opens a sequence, and its gap is looked up among the single, pair and
triple sums of the lengths still available; where none fills it exactly, the
longest fitting piece (best fit) narrows the gap and the lookup is repeated.
A pattern is applied as often as the counts allow, so the plan's size depends
on the number of lengths, not on the number of pieces.

Pieces of one length are interchangeable.  Each has a rank among its length
(its place in its partition plus the counts of the partitions before), and the
plan maps intervals of ranks to sequences and offsets.  No task holds more than
a batch of pieces and no length, however common, is gathered anywhere.

Defined results: a null or empty text is just the end id; repeated rows are
packed each for itself; extra columns are ignored; an empty table gives an
empty result.  Which of two pieces of one length goes where is arbitrary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_batches, stored, table
from .tokens import encoder

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 4096


def cut_pieces(df: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY,
               id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, int] | None = None) -> DataFrame:
    """Columns: id, piece, start, length, ids (binary, little-endian u32), part, at - written and reread.

    ``at`` counts the pieces of the same length before this one in partition ``part``.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen, coder = TaskContext.get().partitionId(), Counter(), encoder(tokenizer, sizes)
        for batch in row_batches(batches, 2000):
            out = []
            wanted = batch["id"].astype(object).where(batch["id"].notna(), None)
            for doc, raw in zip(wanted, coder.encode_all(batch["text"])):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    ids = raw[at:at + 4 * capacity]
                    n = len(ids) // 4
                    out.append((doc, k, at // 4, n, ids, part, seen[n]))
                    seen[n] += 1
            frame = pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids", "part", "at"])
            frame["id"] = frame["id"].astype(object)
            yield frame

    schema = f"id {kind}, piece int, start long, length long, ids binary, part int, at long"
    return stored(rows.mapInPandas(cut, schema), "pieces").withColumnRenamed("id", id_col)


class Lengths:
    """Counts of available lengths with bit masks for complement lookups."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.counts = capacity, {n: c for n, c in counts.items() if c > 0}
        self.mask = sum(1 << n for n in self.counts)
        self.mirror = sum(1 << (capacity - n) for n in self.counts)

    def take(self, n: int, times: int = 1) -> None:
        self.counts[n] -= times
        if not self.counts[n]:
            del self.counts[n]
            self.mask ^= 1 << n
            self.mirror ^= 1 << (self.capacity - n)

    def give(self, n: int, times: int = 1) -> None:
        if n not in self.counts:
            self.counts[n] = 0
            self.mask |= 1 << n
            self.mirror |= 1 << (self.capacity - n)
        self.counts[n] += times

    def longest(self, most: int) -> int:
        """The longest available length up to ``most``; 0 if there is none."""
        return max((self.mask & ((2 << most) - 1)).bit_length() - 1, 0)

    def pair(self, total: int) -> list[int] | None:
        """Two available lengths with this sum, the longest possible first."""
        both = self.mask & (self.mirror >> (self.capacity - total))  # x and total - x
        x = both.bit_length() - 1
        if x < 1 or 2 * x == total and self.counts[x] < 2:
            return None
        return [x, total - x]

    def exact(self, gap: int, most: int = 3) -> list[int] | None:
        """Up to ``most`` (three at the highest) available lengths that fill the gap exactly."""
        if most and gap in self.counts:
            return [gap]
        if most > 1 and (found := self.pair(gap)):
            return found
        if most < 3:
            return None
        z = self.longest(gap - 2) if gap > 2 else 0
        while 3 * z >= gap:  # the longest of three has a third of the gap at least
            self.take(z)
            found = self.pair(gap - z)
            self.give(z)
            if found:
                return [z, *found]
            z = self.longest(z - 1) if z > 1 else 0
        return None


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: times in one sequence}, number of sequences) that use every piece.

    Triples can spend short pieces that longer gaps would have needed, so plans with fewer
    summands are made as well; the one with the fewest sequences is taken."""
    plans = [plan_with(counts, capacity, most) for most in (3, 2, 1, 0)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def plan_with(counts: dict[int, int], capacity: int, most: int) -> list[tuple[dict[int, int], int]]:
    left, plan = Lengths(counts, capacity), []
    while left.counts:
        chosen: list[int] = []
        gap = capacity
        while gap:
            fill = left.exact(gap, most) if chosen else None
            if fill is None:
                best = left.longest(gap)
                if not best:
                    break
                fill = [best]
            for n in fill:
                left.take(n)
            chosen += fill
            gap -= sum(fill)
        pattern = Counter(chosen)
        more = min(left.counts.get(n, 0) // m for n, m in pattern.items())
        if more:
            for n, m in pattern.items():
                left.take(n, more * m)
        plan.append((dict(pattern), 1 + more))
    return plan


def plan_intervals(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, times per sequence, first sequence, offset), sorted by length and rank."""
    used, rows, sequence = Counter(), [], 0
    for pattern, times in plan:
        offset = 0
        for n, m in pattern.items():
            rows.append((n, used[n], m, sequence, offset))
            used[n] += m * times
            offset += m * n
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with length, part, at) with sequence_id and offset in place of part and at."""
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    intervals = pieces.sparkSession.sparkContext.broadcast(plan_intervals(plan_packing(counts, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def lookup(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = intervals.value
        key = (table[:, 0] << 48) + table[:, 1]
        row = table[np.searchsorted(key, (length.to_numpy() << 48) + rank.to_numpy(), side="right") - 1]
        nth = rank.to_numpy() - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + nth // row[:, 2], "offset": row[:, 4] + nth % row[:, 2] * row[:, 0]})

    ranked = pieces.join(bases, ["length", "part"]).withColumn("__place", lookup("length", F.col("base") + F.col("at")))
    columns = [c for c in pieces.columns if c not in ("part", "at")]
    return ranked.select(*columns, "__place.sequence_id", "__place.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """Packed sequences (sequence_id, ids array, lengths array) of placed pieces that carry ``ids``.

    A sequence has at most the capacity's number of ids."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))

    @F.pandas_udf("array<long>")
    def numbers(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: np.frombuffer(b, dtype="<u4").astype(np.int64))

    out = placed.groupBy("sequence_id").agg(rows.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return out.select("sequence_id", numbers(joined).alias("ids"), F.col("p.length").alias("lengths"))


def pack_documents(df: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY,
                   id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, int] | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset; ``sizes`` are the encoder's."""
    pieces = cut_pieces(df, tokenizer, end_id, capacity, id_col, text_col, sizes)
    digested = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(digested, capacity).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
