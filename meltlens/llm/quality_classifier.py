"""Operator 4 - quality classifier: a factorisation machine.

A text becomes a sparse vector: hashed words (log counts, unit length) and
structure statistics with the length as metadata.  The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so pairwise interactions of rank ``RANK`` cost time linear in the text's
distinct words.  The machine is fitted on a bounded sample of labelled rows
(``MAX_TRAIN_ROWS``, those with the smallest id hash) in one task, and every
document's whole text is scored where it is read.

Defined results: a null or empty text is scored from its structure statistics;
rows with a null or other label than 0 and 1 are not learnt from; repeated rows
count as often as they occur; without labels of both classes every score is the
share of label 1 (0.5 without any); extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_batches, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
WORD_DIMS = 1 << 14
RANK = 4
#: Bound on the labelled rows a machine is fitted on.
MAX_TRAIN_ROWS = 20_000
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 128, 0.05, 1e-5, 7
STRUCTURE = ["symbols", "upper", "shouted", "pipes", "repeats", "unique", "repeated_lines", "top_word", "word_length",
             "digits", "stops", "length", "line_length", "short", "empty"]
DIMS = WORD_DIMS + len(STRUCTURE)


def structure(text: str, words: list[str], counts: Counter) -> list[float]:
    n = len(words)
    if not n:
        return [0.0] * (len(STRUCTURE) - 2) + [1.0, 1.0]
    chars = max(len(text), 1)
    letters = sum(map(str.isalpha, text))
    lines = [line for line in text.split("\n") if line.strip()]
    windows = len(set(zip(words, words[1:], words[2:])))
    return [
        min(len(SYMBOL.findall(text)) / n, 3) / 3, sum(map(str.isupper, text)) / max(letters, 1),
        sum(w.endswith("!!") for w in words) / n, words.count("|") / n, 1 - windows / max(n - 2, 1) if n > 2 else 0.0,
        len(counts) / n, 1 - len(set(lines)) / max(len(lines), 1), max(counts.values()) / n, min(chars / n, 20) / 20,
        sum(map(str.isdigit, text)) / chars, text.count(".") / n, math.log1p(n) / 10, math.log1p(chars / len(lines)) / 10,
        float(n < 50), 0.0]


_BUCKETS: dict[str, int] = {}


def bucket(word: str) -> int:
    found = _BUCKETS.get(word)
    if found is None:
        if len(_BUCKETS) > 500_000:
            _BUCKETS.clear()
        found = _BUCKETS[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_DIMS
    return found


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature indexes and values of a text."""
    text = text or ""
    words = WORD.findall(text)
    counts = Counter(words)
    index = np.fromiter(map(bucket, counts), dtype=np.int32, count=len(counts))
    value = np.log1p(np.fromiter(counts.values(), dtype=np.float32, count=len(counts)))
    value /= max(float(np.sqrt((value * value).sum())), 1e-9)
    extra = np.asarray(structure(text, words, counts), dtype=np.float32)
    return (np.concatenate([index, np.arange(WORD_DIMS, DIMS, dtype=np.int32)]), np.concatenate([value, extra]))


def stack(vectors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as (start of each row, indexes, values); no row is empty."""
    starts = np.cumsum([0, *(len(i) for i, _ in vectors[:-1])])
    return starts, np.concatenate([i for i, _ in vectors]), np.concatenate([x for _, x in vectors])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, starts: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the factor sums of each row."""
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx * vx, starts)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        margin, _ = self.margins(*stack([vector(t) for t in texts]))
        return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30)))

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.bias], self.linear, self.factors.ravel()]).astype("<f4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Machine":
        flat = np.frombuffer(raw, dtype="<f4")
        return cls(float(flat[0]), flat[1:1 + DIMS], flat[1 + DIMS:].reshape(DIMS, RANK))


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Mini-batch AdaGrad on the log loss, the rarer class weighted up to balance."""
    rng = np.random.default_rng(SEED)
    machine = Machine(0.0, np.zeros(DIMS, np.float32), rng.normal(0, 0.01, (DIMS, RANK)).astype(np.float32))
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        machine.bias = 30.0 if share == 1 else -30.0 if share == 0 else 0.0
        machine.factors[:] = 0
        return machine
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    bias2, linear2, factors2 = 1e-6, np.full(DIMS, 1e-6, np.float32), np.full((DIMS, RANK), 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            starts, index, value = stack([vectors[r] for r in rows])
            margin, sums = machine.margins(starts, index, value)
            slope = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            row_of = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(index))))
            gx = slope[row_of] * value
            touched, place = np.unique(index, return_inverse=True)
            linear = np.bincount(place, gx, len(touched)).astype(np.float32) + DECAY * machine.linear[touched]
            pull = gx[:, None] * (sums[row_of] - machine.factors[index] * value[:, None])
            factors = np.stack([np.bincount(place, pull[:, f], len(touched)) for f in range(RANK)], axis=1).astype(np.float32)
            factors += DECAY * machine.factors[touched]
            linear2[touched] += linear * linear
            factors2[touched] += factors * factors
            machine.linear[touched] -= RATE * linear / np.sqrt(linear2[touched])
            machine.factors[touched] -= RATE * factors / np.sqrt(factors2[touched])
            total = float(slope.sum())
            bias2 += total * total
            machine.bias -= RATE * total / math.sqrt(bias2)
    return machine


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_rows: int = MAX_TRAIN_ROWS) -> Machine:
    """Fit on at most ``max_rows`` labelled rows whose id is not held out."""
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
              .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
              .withColumn("at", F.xxhash64("id")).orderBy("at", "id", "y").limit(max_rows))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in row_batches(batches, 1000):
            found = [vector(t) for t in batch["text"]]
            yield pd.DataFrame({"at": batch["at"], "y": batch["y"], "i": [i.tobytes() for i, _ in found],
                                "x": [x.tobytes() for _, x in found]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = [row for batch in batches for row in zip(batch["at"], batch["y"], batch["i"], batch["x"])]
        sample.sort()
        vectors = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for *_, i, x in sample]
        yield pd.DataFrame({"model": [fit(vectors, np.array([y for _, y, *_ in sample], dtype=np.float64)).to_bytes()]})

    # repeated documents could multiply the rows: the bound holds for what is learnt from, too
    sample = rows.mapInPandas(features, "at long, y int, i binary, x binary").orderBy("at").limit(max_rows)
    return Machine.from_bytes(bytes(sample.repartition(1).mapInPandas(learn, "model binary").head()["model"]))


def score_documents(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: id, score - one row per input row."""
    model = docs.sparkSession.sparkContext.broadcast(machine.to_bytes())

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Machine.from_bytes(model.value)
        for batch in texts:
            parts = [own.score(list(batch.iloc[at:at + 200])) for at in range(0, len(batch), 200)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return docs.select(F.col(id_col), score(F.col(text_col)).alias("score"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
