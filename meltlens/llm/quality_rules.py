"""Operator 3 - quality rules as a short-circuit cascade.

The base statistics are computed for every whole text.  The method's rules then
run as a cascade: a rule only sees texts that no earlier rule rejected.  The
order comes from a bounded sample (``SAMPLE_ROWS`` rows, drawn by hash): each rule's time per text and share of rejected texts are measured
and rules are ordered by rejections per second.  The order changes the cost
only; a text is kept when it passes every rule, in whatever order.

Defined results: a null or empty text has no words (all counts 0), fails the
base and is not kept.  Repeated rows are judged each for itself, extra columns
are ignored by ``judge_documents`` and carried by ``keep_documents``, an empty
table gives an empty result.  Texts are never shortened.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_batches, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")

#: Thresholds of the rules (rejected at or above the share).
MAX_SYMBOLS_PER_WORD = 0.1
MAX_UPPER_SHARE = 0.3
MAX_SHOUTED_SHARE = 0.1
MAX_TOP_WORD_SHARE = 0.3
MIN_MEAN_WORD, MAX_MEAN_WORD = 2.0, 15.0
#: Rows on which cost and selectivity of the rules are estimated.
SAMPLE_ROWS = 1000

STATS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "base_failed boolean, kept boolean")


class Text:
    """A text with its words and base statistics."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = WORD.findall(self.text)
        self.n_words = len(self.words)
        self.word_chars = sum(map(len, self.words))
        self.n_symbols = len(SYMBOL.findall(self.text))
        self.n_dup_lines = duplicate_lines(self.text)
        self.n_repeat_words = repeated_words(self.words)
        self.base_failed = self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(lines) - len(set(lines))


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + 3 - max(at, end)
            end = at + 3
    return covered


def too_many_symbols(t: Text) -> bool:
    return t.n_symbols >= MAX_SYMBOLS_PER_WORD * t.n_words


def mostly_upper(t: Text) -> bool:
    # lower() equals the text where nothing is cased upper: the cheap way out
    letters = sum(map(str.isalpha, t.text))
    return letters > 0 and sum(map(str.isupper, t.text)) >= MAX_UPPER_SHARE * letters


def shouted(t: Text) -> bool:
    return "!!" in t.text and sum(w.endswith("!!") for w in t.words) >= MAX_SHOUTED_SHARE * t.n_words


def one_word_dominates(t: Text) -> bool:
    return max(Counter(t.words).values(), default=0) >= MAX_TOP_WORD_SHARE * t.n_words


def odd_word_length(t: Text) -> bool:
    return not MIN_MEAN_WORD * t.n_words <= t.word_chars <= MAX_MEAN_WORD * t.n_words


#: name -> whether the rule rejects the text
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": too_many_symbols,
    "upper": mostly_upper,
    "shouted": shouted,
    "top_word": one_word_dominates,
    "word_length": odd_word_length,
}


def survives(text: Text, order: list[str]) -> bool:
    return not text.base_failed and not any(RULES[name](text) for name in order)


def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per rule: texts seen, texts rejected and seconds spent."""
    seen, rejected, seconds = 0, Counter(), Counter()
    for batch in batches:
        for value in batch["text"]:
            text = Text(value)
            if text.base_failed:
                continue
            seen += 1
            for name, rule in RULES.items():
                began = time.perf_counter()
                rejected[name] += rule(text)
                seconds[name] += time.perf_counter() - began
    yield pd.DataFrame({"rule": list(RULES), "seen": seen, "rejected": [rejected[n] for n in RULES],
                        "seconds": [float(seconds[n]) for n in RULES]})


def rule_order(df: DataFrame, text_col: str, key_col: str, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules by rejections per second on a bounded sample; unmeasured rules keep their place."""
    share = min(1.0, 2 * sample_rows / max(df.count(), 1))  # some twice as many rows leave their partitions
    drawn = F.pmod(F.xxhash64(F.col(key_col), F.col(text_col)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = df.where(drawn).select(F.col(text_col).alias("text")).limit(sample_rows)
    rows = (sample.mapInPandas(measure, "rule string, seen long, rejected long, seconds double")
            .groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")).collect())
    gain = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in rows}
    return sorted(RULES, key=lambda name: -gain.get(name, 0.0))


def judge_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    order: list[str] | None = None) -> DataFrame:
    """Columns: id and STATS, one row per input row."""
    order = order or rule_order(df, text_col, id_col)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in row_batches(batches, 2000):
            texts = map(Text, batch["text"])
            rows = [(t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed,
                     survives(t, order)) for t in texts]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in STATS.split(", ")])
            out.insert(0, "row_id", batch["row_id"].to_numpy())
            yield out

    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["row_id"]
    return rows.mapInPandas(judge, f"row_id {kind}, {STATS}").withColumnRenamed("row_id", id_col)


def keep_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` (all its columns) whose text passes the base and every rule."""
    order = rule_order(df, text_col, id_col)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([survives(Text(t), order) for t in texts], dtype=bool)

    return df.where(kept(F.col(text_col)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with base as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
d as (
  select rid, doc_id, len(w)::bigint as n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
         w, text
  from base),
wins as (
  select rid, unnest(range(1, n_words - 1)) as i, w from d where n_words >= 3),
keyed as (select rid, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] as k from wins),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as n from keyed) where n > 1),
cov as (
  select rid, count(distinct p)::bigint as n_repeat_words
  from (select rid, unnest([i, i + 1, i + 2]) as p from rep) group by rid),
top as (
  select rid, max(n) as top_n from (select rid, x, count(*) as n from (select rid, unnest(w) as x from d) group by all)
  group by rid),
s as (
  select d.*, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(top_n, 0) as top_n,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         len(regexp_extract_all(text, '\pL')) as letters,
         len(regexp_extract_all(text, '\p{Lu}')) as uppers,
         len(list_filter(w, lambda x: suffix(x, '!!'))) as shouts
  from d left join cov using (rid) left join top using (rid)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and n_symbols < 0.1 * n_words and (letters = 0 or uppers < 0.3 * letters)
       and (shouts = 0 or shouts < 0.1 * n_words) and top_n < 0.3 * n_words
       and word_chars >= 2 * n_words and word_chars <= 15 * n_words as kept
from f
"""
