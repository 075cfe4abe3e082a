"""Operator 9 - token ids as directly addressable codes.

An id is split into 8-bit chunks.  Level 0 holds the low chunk of every token
with one continuation bit each; level k holds chunk k of the tokens whose
continuation bit is set on level k - 1.  A rank directory (ones before each
512-bit block) turns a position on one level into the position on the next, so
token i is read in a few steps without decoding anything before it.

Documents are range-partitioned and sorted by id, encoded in order, and written
as rows of Parquet files: a segment row has a bounded number of tokens (a
longer document has a segment to itself), the documents' ids and lengths, and
the codes as one binary value.  Only one token count per partition is gathered
to give every segment its global position.

Defined results: a null or empty text is just the end id; null ids come first;
equal ids stand in the order of their texts' hashes; repeated rows are each
written; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_batches, scratch_path, table
from .tokens import encoder

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SEGMENT_TOKENS = 1 << 20
BLOCK_BITS = 512
BITS_SET = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint32)


def encode(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned ids."""
    rest, levels = np.asarray(ids, dtype=np.uint32), []
    while True:
        more = rest >= 256
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK_BITS // 8), dtype=np.uint8)])
        per_block = BITS_SET[bits].reshape(-1, BLOCK_BITS // 8).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per_block)]).astype("<u4")
        levels.append((len(rest), rest.astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [struct.pack("<4sI", b"DAC1", len(levels))]
    for n, chunks, bits, ranks in levels:
        out += [struct.pack("<QQQ", n, len(bits), len(ranks)), chunks, bits, ranks]
    return b"".join(out)


class Codes:
    """Random access into encoded ids."""

    def __init__(self, raw: bytes):
        magic, count = struct.unpack_from("<4sI", raw)
        if magic != b"DAC1":
            raise ValueError("not a code segment")
        at, self.levels = 8, []
        for _ in range(count):
            n, bits, ranks = struct.unpack_from("<QQQ", raw, at)
            at += 24
            parts = (np.frombuffer(raw, np.uint8, n, at), np.frombuffer(raw, np.uint8, bits, at + n),
                     np.frombuffer(raw, "<u4", ranks // 4, at + n + bits))
            self.levels.append(parts)
            at += n + bits + ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def rank(bits: np.ndarray, ranks: np.ndarray, at: int) -> int:
        """Continuation bits set before position ``at``."""
        block = at // BLOCK_BITS
        whole, odd = divmod(at - block * BLOCK_BITS, 8)
        first = block * (BLOCK_BITS // 8)
        found = int(ranks[block]) + int(BITS_SET[bits[first:first + whole]].sum())
        return found + (bin(int(bits[first + whole]) & ((1 << odd) - 1)).count("1") if odd else 0)

    def __getitem__(self, at: int) -> int:
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[at]) << (8 * k)
            if not bits[at >> 3] >> (at & 7) & 1:
                break
            at = self.rank(bits, ranks, at)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids of positions start to stop; touches only these positions' chunks."""
        value = np.zeros(stop - start, dtype=np.uint32)
        where = np.arange(stop - start)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if start >= stop:
                break
            value[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * k)
            first = start >> 3
            more = np.unpackbits(bits[first:(stop + 7) >> 3], bitorder="little")[start - 8 * first:stop - 8 * first]
            where = where[more.astype(bool)]
            start, stop = self.rank(bits, ranks, start), self.rank(bits, ranks, stop)
        return value


def segment_schema(kind: str) -> str:
    return (f"part int, seq int, local_start long, n_tokens long, doc_ids array<{kind}>, "
            "lengths array<long>, codes binary")


def write_codes(df: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id",
                text_col: str = "text") -> str:
    """Write the segments of all documents, in ascending id order, to Parquet files at ``path``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    kind = dict(rows.dtypes)["id"]
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, at = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        codes: list[bytes] = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal seq, at, size, ids, codes
            flat = np.frombuffer(b"".join(codes), dtype="<u4")
            out = pd.DataFrame({"part": [part], "seq": [seq], "local_start": [at], "n_tokens": [len(flat)], "doc_ids": [ids],
                                "lengths": [[len(c) // 4 for c in codes]], "codes": [encode(flat)]})
            seq, at, size, ids, codes = seq + 1, at + len(flat), 0, [], []
            return out

        coder = encoder(tokenizer)
        for batch in row_batches(batches, 2000):
            wanted = batch["id"].astype(object).where(batch["id"].notna(), None)
            for doc, code in zip(wanted, coder.encode_all(batch["text"])):
                code += end
                if size and size + len(code) // 4 > SEGMENT_TOKENS:
                    yield flush()
                ids.append(doc)
                codes.append(code)
                size += len(code) // 4
        if size:
            yield flush()

    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    ordered.mapInPandas(segments, segment_schema(kind)).write.option("compression", "zstd").parquet(path)
    return path


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with their global ``start``: the tokens of all documents before them."""
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per written partition, whatever the data's size
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("part_start") + F.col("local_start"))


def read_documents(spark: SparkSession, path: str, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Columns: id, start, n_tokens, ids_crc32 and, on request, ids - decoded from the files."""
    segments = read_segments(spark, path)
    kind = dict(segments.dtypes)["doc_ids"][len("array<"):-1]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, docs, lengths, raw in zip(batch["start"], batch["doc_ids"], batch["lengths"], batch["codes"]):
                codes, at, out = Codes(raw), 0, []
                for doc, n in zip(docs, lengths):
                    ids = codes.slice(at, at + n)
                    out.append((doc, start + at, n, zlib.crc32(ids.astype("<u4").tobytes()), ids if with_ids else None))
                    at += n
                frame = pd.DataFrame(out, columns=["id", "start", "n_tokens", "ids_crc32", "ids"])
                frame["id"] = frame["id"].astype(object)
                yield frame if with_ids else frame.drop(columns="ids")

    narrow = segments.select("start", "doc_ids", "lengths", "codes")
    schema = f"id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return narrow.mapInPandas(decode, schema).withColumnRenamed("id", id_col)


def token_at(spark: SparkSession, path: str, position: int) -> int | None:
    """The id at a global position, read from the one segment that holds it."""
    found = (read_segments(spark, path).where((F.col("start") <= position) & (F.col("start") + F.col("n_tokens") > position))
             .select("start", "codes").head())
    return None if found is None else Codes(bytes(found["codes"]))[position - found["start"]]


def op9_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(spark, write_codes(table(spark, sf_dir, "documents"), scratch_path(spark, "codes")))
