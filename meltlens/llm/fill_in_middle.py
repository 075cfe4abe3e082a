"""Operator 12 - fill-in-the-middle by an indexable skip list.

A text is cut into units (a run of A-Z letters, or one other code point).  Lane
0 of a skip list holds every unit's width in code points; lane k links every
16^k-th unit to the next such one and carries the link's width in units and in
code points.  A cut rank is reached from the top lane down: a link is followed
while its unit width still fits before the rank, and the code-point widths on
the way add up to the cut's place in the text.  At most 15 links are followed
on a lane, so a cut in a text of n units takes some log16(n) short steps.

Prefix, middle and suffix are put out in prefix-suffix-middle or
suffix-prefix-middle order behind the markers, or the text stays plain.  Cuts
and form depend on the id only through SHA-256, so reruns agree and copies with
different ids are cut differently.

Defined results: a null text is the empty one; an empty text and one that holds
a marker stay plain; a null id has the digest of ``1:``; repeated rows have
equal results; extra columns are ignored; an empty table gives an empty result.
Texts are never shortened.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_batches, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
FANOUT = 16
SEED = 1
#: Rows handed over at once; texts are copied a few times.
BATCH_ROWS = 200


def unit_widths(text: str) -> np.ndarray:
    """Code points of every unit of a text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    letter = ((points | 32) - 97) < 26  # unsigned: smaller code points wrap around
    starts = ~letter
    starts[:1] = True
    starts[1:] |= ~letter[:-1]
    return np.diff(np.append(np.flatnonzero(starts), len(points)))


class SkipList:
    """Express lanes over unit widths."""

    def __init__(self, widths: np.ndarray, fanout: int = FANOUT):
        self.fanout, self.n = fanout, len(widths)
        units, points = np.ones(self.n, dtype=np.int64), widths.astype(np.int64)
        self.lanes = [(units, points)]
        while len(units) > fanout:
            links = np.arange(0, len(units), fanout)
            units, points = np.add.reduceat(units, links), np.add.reduceat(points, links)
            self.lanes.append((units, points))

    def offset(self, rank: int) -> int:
        """Code points before unit ``rank``; the list's end for a rank of ``n``."""
        at = units = points = 0  # at: the link on the present lane
        for unit_width, point_width in reversed(self.lanes):
            at *= self.fanout
            while at < len(unit_width) and units + unit_width[at] <= rank:
                units += int(unit_width[at])
                points += int(point_width[at])
                at += 1
        return points


def draws(doc: object, seed: int) -> list[int]:
    """Four 32-bit numbers of an id."""
    found = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    return [int(found[i:i + 8], 16) for i in range(0, 32, 8)]


def transform(doc: object, text: str | None, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix code points, middle code points, output)."""
    text = text or ""
    units = SkipList(unit_widths(text))
    h1, h2, h3, h4 = draws(doc, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - PLAIN_PERCENT:
        return units.n, "plain", None, None, text
    low, high = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.offset(low), units.offset(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_PERCENT:
        return units.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Columns: id, n, form, prefix_chars, middle_chars, output - one row per input row."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in row_batches(batches, BATCH_ROWS):
            ids = batch["id"].astype(object).where(batch["id"].notna(), None)
            out = [(doc, *transform(doc, text, seed)) for doc, text in zip(ids, batch["text"])]
            frame = pd.DataFrame(out, columns=["id", "n", "form", "prefix_chars", "middle_chars", "output"], dtype=object)
            yield frame

    # the id as text: an integer column with nulls would arrive as floats
    text_ids = rows.select(F.col("id").cast("string").alias("id"), "text")
    schema = "id string, n long, form string, prefix_chars long, middle_chars long, output string"
    return text_ids.mapInPandas(cut, schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.  A cut text holds no marker, so each is found once, in order."""
    parts = F.split(output, "<[PSM]>", -1)  # what precedes the first marker is empty
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
         sha256('1:' || coalesce(doc_id::varchar, '')) as h
  from documents),
n as (
  select *, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3,
         ('0x' || h[25:32])::bigint as h4
  from d),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from n),
p as (
  select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:n], '') as suf from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre) end as prefix_chars,
       case when form <> 'plain' then length(mid) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
              else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(text) as restored_sha256
from p
"""
