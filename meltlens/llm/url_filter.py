"""Operator 1 - URL filter over a sorted digest array.

Every list entry is a string ``host + path prefix``.  The 64-bit xxhash keys of
the entries are sorted into one file together with the strings; executors
memory-map that file, probe it with a vectorised binary search and compare the
stored string of every hit, so a digest collision never decides a url.

A url is probed with each of its domain suffixes joined to each prefix of its
path whose length occurs in the list.  The longest fitting entry wins (ties:
the longer host).  Rules decide first; urls no rule fits get the verdict of the
block list.

Defined results: a null url, or one without ``://``, has empty host and path,
fits nothing and is allowed.  Repeated rows are judged each for itself, further
columns of the input are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored, table

#: (host, path prefix, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: The query's block list if it is given none: four example hosts, those that the test pages hold; a host blocks all its
#: subdomains and paths.
BLOCKED_HOSTS = [
    "casino-win.example.com", "free-bets.example.com",
    "cheap-pills.example.com", "ads-track.example.com",
]
#: Above this size the index is not shipped to executors (see filter_urls_by_join).
MAX_INDEX_BYTES = 256 << 20

VERDICT_CODES = ["allow", "block", "listed"]


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def build_index(entries: Iterable[tuple[str, str, str]]) -> bytes:
    """Serialise entries: header, sorted digests, string offsets, host lengths, codes, strings.

    Repeated entries are stored once; the first verdict given to a string stays.
    """
    unique: dict[tuple[str, str], str] = {}
    for host, path, verdict in entries:
        unique.setdefault((host, path), verdict)
    rows = sorted((digest(h + p), h, p, v) for (h, p), v in unique.items())
    keys = np.array([r[0] for r in rows], dtype="<u8")
    strings = [(r[1] + r[2]).encode("utf-8", "surrogatepass") for r in rows]
    offsets = np.zeros(len(rows) + 1, dtype="<u8")
    np.cumsum([len(s) for s in strings], out=offsets[1:])
    hosts = np.array([len(r[1]) for r in rows], dtype="<u4")
    codes = np.array([VERDICT_CODES.index(r[3]) for r in rows], dtype="<u4")
    paths = sorted({len(r[2]) for r in rows})
    lengths = np.array(paths, dtype="<u4")
    return b"".join([struct.pack("<QQ", len(rows), len(lengths)), keys.tobytes(), offsets.tobytes(),
                     hosts.tobytes(), codes.tobytes(), lengths.tobytes(), b"".join(strings)])


@dataclass
class DigestArray:
    """Read-only view of an index file (memory-mapped)."""

    keys: np.ndarray
    offsets: np.ndarray
    hosts: np.ndarray
    codes: np.ndarray
    path_lengths: list[int]
    strings: np.ndarray

    @classmethod
    def open(cls, path: str) -> "DigestArray":
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n, m = struct.unpack("<QQ", raw[:16].tobytes())
        at = 16
        parts = []
        for count, kind in ((n, "<u8"), (n + 1, "<u8"), (n, "<u4"), (n, "<u4"), (m, "<u4")):
            size = count * np.dtype(kind).itemsize
            parts.append(raw[at:at + size].view(kind))
            at += size
        return cls(*parts[:4], parts[4].tolist(), raw[at:])

    def probe(self, texts: list[str], host_lengths: list[int]) -> np.ndarray:
        """Index of the entry equal to each probe (string and host length), or -1."""
        found = np.full(len(texts), -1, dtype=np.int64)
        if not len(self.keys) or not texts:
            return found
        wanted = np.fromiter((digest(t) for t in texts), dtype=np.uint64, count=len(texts))
        at = np.searchsorted(self.keys, wanted)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted))
        for k in hit.tolist():
            text, i = texts[k].encode("utf-8", "surrogatepass"), int(at[k])
            while i < len(self.keys) and self.keys[i] == wanted[k]:  # equal digests stand together
                stored = self.strings[int(self.offsets[i]):int(self.offsets[i + 1])].tobytes()
                if stored == text and self.hosts[i] == host_lengths[k]:
                    found[k] = i
                    break
                i += 1
        return found


def probes_of(host: str, path: str, path_lengths: list[int]) -> Iterator[tuple[str, int]]:
    """Every (suffix + path prefix, host length) an entry that fits this url can have."""
    if not host:
        return
    usable = path_lengths[:bisect.bisect_right(path_lengths, len(path))]
    suffix = host
    while True:
        for n in usable:
            yield suffix + path[:n], len(suffix.encode("utf-8", "surrogatepass")) if not suffix.isascii() else len(suffix)
        dot = suffix.find(".")
        if dot < 0:
            return
        suffix = suffix[dot + 1:]


def judge(array: DigestArray, hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
    texts: list[str] = []
    lengths: list[int] = []
    owner: list[int] = []
    for k, (host, path) in enumerate(zip(hosts, paths)):
        for text, n in probes_of(host, path, array.path_lengths):
            texts.append(text)
            lengths.append(n)
            owner.append(k)
    rule: list[str | None] = [None] * len(hosts)
    entry: list[str | None] = [None] * len(hosts)
    verdict = ["allow"] * len(hosts)
    best = [(-1, -1)] * len(hosts)
    found = array.probe(texts, lengths)
    for j in np.flatnonzero(found >= 0).tolist():
        k, code = owner[j], VERDICT_CODES[array.codes[found[j]]]
        if code == "listed":
            if entry[k] is None or len(texts[j]) > len(entry[k]):
                entry[k] = texts[j]
        elif (len(texts[j]), lengths[j]) > best[k]:
            best[k], rule[k], verdict[k] = (len(texts[j]), lengths[j]), texts[j], code
    for k, listed in enumerate(entry):
        if rule[k] is None and listed is not None:
            verdict[k] = "block"
    return pd.DataFrame({"rule": rule, "verdict": verdict, "listed_entry": entry})


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


#: (application, file name) of the indexes this driver has sent.
_SENT: set[tuple[str, str]] = set()


def ship_index(spark: SparkSession, index: bytes) -> str:
    """Send the index file to every executor, present and future; returns its name there."""
    if len(index) > MAX_INDEX_BYTES:
        raise ValueError(f"index of {len(index)} bytes is above {MAX_INDEX_BYTES}; use filter_urls_by_join")
    name = f"urls-{hashlib.sha256(index).hexdigest()[:32]}.idx"
    sent = (spark.sparkContext.applicationId, name)
    if sent in _SENT:
        return name
    path = os.path.join(tempfile.mkdtemp(prefix="urls-"), name)  # only Spark's file server reads it
    with open(path, "wb") as out:
        out.write(index)
    spark.sparkContext.addFile(path)
    _SENT.add(sent)
    return name


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]], blocked_hosts: Iterable[str],
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Columns: id, host, path, rule, verdict, listed_entry (the block-list entry met)."""
    index = build_index([*rules, *((h, "", "listed") for h in blocked_hosts)])
    name = ship_index(df.sparkSession, index)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = DigestArray.open(SparkFiles.get(name))
        for batch in batches:
            batch = batch.reset_index(drop=True)
            yield pd.concat([batch, judge(array, batch["host"], batch["path"])], axis=1)

    host, path = split_url(F.col(url_col))
    rows = df.select(F.col(id_col).alias("row_id"), host.alias("host"), path.alias("path"))
    kind = dict(rows.dtypes)["row_id"]
    out = rows.mapInPandas(probe, f"row_id {kind}, host string, path string, rule string, verdict string, "
                                  "listed_entry string")
    return out.withColumnRenamed("row_id", id_col)


def filter_urls_by_join(df: DataFrame, entries: DataFrame, path_lengths: list[int],
                        id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The same verdicts for a list too large to ship: ``entries(host, path, verdict)``.

    Distinct (host, path) pairs are probed by an equi-join on the entry's parts,
    so a hot host is probed once per distinct path.
    """
    host, path = split_url(F.col(url_col))
    rows = df.select(F.col(id_col).alias("row_id"), host.alias("host"), path.alias("path"))
    urls = rows.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    probes = (urls.withColumn("e_host", F.explode(suffixes))
              .withColumn("n", F.explode(F.array(*[F.lit(int(n)) for n in path_lengths])))
              .where(F.length("path") >= F.col("n"))
              .withColumn("e_path", F.substring("path", F.lit(1), F.col("n"))))
    listed = entries.select(F.col("host").alias("e_host"), F.col("path").alias("e_path"),
                            F.col("verdict").alias("e_verdict")).dropDuplicates(["e_host", "e_path"])
    hits = probes.join(listed, ["e_host", "e_path"])
    text = F.concat("e_host", "e_path")
    rank = F.struct(F.length(text), F.length("e_host"))
    ruled = F.col("e_verdict") != "listed"
    best = hits.groupBy("host", "path").agg(
        F.max_by(F.when(ruled, text), F.when(ruled, rank)).alias("rule"),
        F.max_by(F.when(ruled, F.col("e_verdict")), F.when(ruled, rank)).alias("ruled"),
        F.max_by(F.when(~ruled, text), F.when(~ruled, rank)).alias("listed_entry"))
    out = rows.join(best, ["host", "path"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("listed_entry").isNotNull(), "block"), F.lit("allow"))
    return out.select(F.col("row_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "listed_entry")


def filter_urls_by_list(df: DataFrame, rules: list[tuple[str, str, str]], blocklist: DataFrame, host_col: str = "host",
                        id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``filter_urls`` with a list of any size from a table: an index file if it fits ``MAX_INDEX_BYTES``, else the join.

    Hosts are trimmed and lower-cased (A-Z); null, empty and repeated ones are left out.
    """
    host = F.trim(F.translate(F.col(host_col), UPPER, LOWER))
    hosts = stored(blocklist.select(host.alias("host")).where("host <> ''").distinct(), "blocklist")
    size = hosts.agg(F.coalesce(F.sum(F.octet_length("host") + 24), F.lit(0))).first()[0]  # key, offset, length and code
    if size + sum(len((h + p).encode()) + 24 for h, p, _ in rules) + 1024 <= MAX_INDEX_BYTES:
        return filter_urls(df, rules, [r.host for r in hosts.toLocalIterator()], id_col, url_col)
    given = df.sparkSession.createDataFrame(rules, "host string, path string, verdict string")
    entries = given.unionByName(hosts.select("host", F.lit("").alias("path"), F.lit("listed").alias("verdict")))
    return filter_urls_by_join(df, entries, sorted({len(p) for _, p, _ in rules} | {0}), id_col, url_col)


def op1_url_filter(spark: SparkSession, sf_dir: str, blocklist: DataFrame | None = None) -> DataFrame:
    """``blocklist``: a table or list file (``spark.read.text(path).toDF("host")``) with the column ``host``."""
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, RULES, BLOCKED_HOSTS) if blocklist is None else filter_urls_by_list(pages, RULES, blocklist)


OP1_SQL = r"""
with u as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') as path
  from pages),
r as (
  select *, case
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/'
  end as rule,
  case when host = 'casino-win.example.com' or host like '%.casino-win.example.com' then 'casino-win.example.com'
       when host = 'free-bets.example.com' or host like '%.free-bets.example.com' then 'free-bets.example.com'
       when host = 'cheap-pills.example.com' or host like '%.cheap-pills.example.com' then 'cheap-pills.example.com'
       when host = 'ads-track.example.com' or host like '%.ads-track.example.com' then 'ads-track.example.com'
  end as listed_entry
  from u)
select page_id, host, path, rule,
       case when rule in ('org/', 'com/fr/') then 'allow'
            when rule is not null then 'block'
            when listed_entry is not null then 'block'
            else 'allow' end as verdict,
       listed_entry
from r
"""
