"""Operator 7 - secret scan with an incremental blob ledger (DataFrame operations only).

Every historical version of a file is content-addressed: its blob id is the
SHA-256 of the whole text.  The ledger (a folder of Parquet batches) remembers
which rule versions have been run on which blob; a scan reads only blobs with
an unseen (blob, rule version) pair, appends its findings, and joins all
findings of the blob back to every path that holds it.  A copy is scanned once.

Spans are code points, end exclusive, leftmost and non-overlapping per rule.
Java's matcher gives the matched strings and ``split`` the text between them;
their running lengths give the positions.

Defined results: a null text is the empty blob and has no findings; a null path
is a path; repeated rows each get the findings; extra columns are ignored by
``scan_versions`` and carried by ``redact``; an empty table gives an empty
result.  Texts are never shortened.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, table


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``min_chars`` characters for a match to count.  ``plain`` is the pattern for engines
    without possessive repeats, where it differs."""

    name: str
    version: int
    pattern: str
    group: int = 0
    min_chars: int = 0
    base: bool = False
    screen: str = ""
    plain: str = ""

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


_ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
           r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]%s)""")

_PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
_BASE64 = "[A-Za-z0-9+/]"


def _private_key(never_back: str) -> str:
    """A key: its header, the lines that describe it, the base64 lines that follow with a shorter last one, and the END line.

    ``never_back`` makes repeats possessive (``+``; Java then loops where it would recurse, so no
    length is bounded) or plain (empty; for engines that need no such mark).  No repeat can take
    what the next one needs, so both find the same spans."""
    n = never_back
    gap = r"[\s\\\"'>#*|,;]"
    end = r"-----END [A-Z ]{0,40}PRIVATE KEY-----"
    named = rf"(?:\s*{n}(?:Proc-Type|DEK-Info|Version|Comment):[^\n]*{n})*{n}"
    lines = rf"(?:{gap}+{n}{_BASE64}{{12,}}{n}={{0,2}}{n})+{n}"
    last = rf"(?:{gap}+{n}{_BASE64}{{1,11}}{n}={{0,2}}{n})?{n}{gap}*{n}{end}"
    whole_line = rf"[\\\"'>#*|,;\t\x20]*{n}\r?\n[>#*\t\x20]*{n}{_BASE64}{{1,11}}{n}={{0,2}}{n}[\t\x20\r]*{n}(?:\n|\z)"
    return rf"{_PEM}{named}(?:{lines}(?:{last}|{whole_line})?{n}|{gap}*{n}{end})?{n}"


#: Order is the order of kinds.  A greedy run that is too short cannot hold a
#: longer match, so access and hex carry their minimum in the pattern.
RULES = [
    Rule("assign", 1, _ASSIGN % "+", group=2, min_chars=6, base=True, screen=_ASSIGN % "{6,}"),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", 1, "[0-9a-f]{24,}", base=True),
    Rule("private_key", 3, _private_key("+"), screen=_PEM, plain=_private_key("")),
    Rule("provider_token", 1, r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|glpat-[A-Za-z0-9_-]{20,})"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
MASK = "[SECRET]"

FINDINGS = "blob binary, rule string, version int, start long, stop long"
SCANNED = "blob binary, rules array<string>"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def has_candidate(text: Column, rules: list[Rule]) -> Column:
    found = F.lit(False)
    for rule in rules:
        found = found | text.rlike(rule.screen or rule.pattern)
    return F.coalesce(found, F.lit(False))


def _pieces(rule: Rule, text: Column) -> Column:
    """Array of (chars before the match, chars of the match, chars of the tested group)."""
    pattern = F.lit(rule.pattern)
    return F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.char_length).alias("before"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length).alias("match"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length).alias("tested"))


def find_spans(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """FINDINGS of ``blobs(blob, text, todo)``, where ``todo`` lists the rule keys to run."""
    text = F.col("text")
    found = [
        F.when(F.array_contains("todo", rule.key) & text.rlike(rule.screen or rule.pattern),
               F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"),
                        F.lit(rule.min_chars).alias("least"), _pieces(rule, text).alias("pieces")))
        for rule in rules]
    per_rule = (blobs.select("blob", F.explode(F.array(*found)).alias("f")).where("f is not null")
                .select("blob", "f.rule", "f.version", "f.least", F.posexplode("f.pieces").alias("at", "p")))
    before = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("p.before") + F.coalesce("p.match", F.lit(0))).over(before)
    return (per_rule.withColumn("stop", stop)
            .where("p.match is not null and p.tested >= least")
            .select("blob", "rule", "version", (F.col("stop") - F.col("p.match")).alias("start"), "stop"))


class Ledger:
    """Scanned (blob, rule version) pairs and their findings, one folder per batch.

    Every batch gets a folder of its own, so nothing that was written is ever replaced, whatever
    the batches are called.  Findings are written first, then the list of scanned blobs: a blob
    whose batch was cut off between the two is scanned again, and findings that stand twice
    count once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, what: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{what}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def unseen(self, blobs: DataFrame, rules: list[Rule]) -> DataFrame:
        """``blobs(blob, text)`` with the rule keys still to run; finished blobs are left out."""
        every = F.array(*[F.lit(r.key) for r in rules])
        seen = self._read("scanned", SCANNED)
        if seen is None:
            return blobs.withColumn("todo", every)
        done = (seen.select("blob", F.explode("rules").alias("rule")).groupBy("blob")
                .agg(F.collect_set("rule").alias("done")))
        joined = blobs.join(done, "blob", "left").withColumn(
            "todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
        return joined.where(F.size("todo") > 0).drop("done")

    def add(self, batch: str, scanned: DataFrame, findings: DataFrame) -> None:
        folder = f"batch-{batch}-{uuid.uuid4().hex}"
        findings.write.parquet(f"{self.path}/findings/{folder}")
        scanned.write.parquet(f"{self.path}/scanned/{folder}")

    def findings(self, rules: list[Rule]) -> DataFrame:
        """Findings of the given rule versions.  Batches can repeat a pair only with the same spans."""
        rows = self._read("findings", FINDINGS)
        if rows is None:
            return self.spark.createDataFrame([], FINDINGS)
        current = F.array(*[F.lit(r.key) for r in rules])
        return rows.where(F.array_contains(current, F.concat_ws("@", "rule", "version"))).distinct()


def update_ledger(texts: DataFrame, ledger: Ledger, batch: str, rules: list[Rule], text_col: str = "text") -> None:
    """Scan the unseen blobs of ``texts`` and add them to the ledger."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = texts.select(blob_id(F.col(text_col)).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    todo = ledger.unseen(blobs, rules)
    ids = texts.select(blob_id(F.col(text_col)).alias("blob")).distinct()
    ledger.add(batch, ledger.unseen(ids, rules).select("blob", F.col("todo").alias("rules")), find_spans(todo, rules))


def spans_by_blob(ledger: Ledger, rules: list[Rule]) -> DataFrame:
    """Per blob with findings: ``spans``, an array of (start, kind order, kind, stop, base), sorted."""
    order, base = F.lit(len(rules)), F.lit(False)
    for i, rule in enumerate(rules):
        order = F.when(F.col("rule") == rule.name, F.lit(i)).otherwise(order)
        base = F.when(F.col("rule") == rule.name, F.lit(rule.base)).otherwise(base)
    span = F.struct(F.col("start"), order.alias("kind_at"), F.col("rule").alias("kind"), F.col("stop"), base.alias("base"))
    return ledger.findings(rules).groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def scan_versions(versions: DataFrame, ledger_path: str | None = None, batch: str = "0",
                  rules: list[Rule] | None = None, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: path, blob, spans - one row per input row, after scanning what the ledger has not seen."""
    rules = rules or RULES
    spark = versions.sparkSession
    ledger = Ledger(spark, ledger_path or scratch_path(spark, "ledger"))
    update_ledger(versions, ledger, batch, rules, text_col)
    paths = versions.select(F.col(path_col).alias("path"), blob_id(F.col(text_col)).alias("blob"))
    return paths.join(spans_by_blob(ledger, rules), "blob", "left").select("path", "blob", "spans")


def redact(df: DataFrame, rules: list[Rule] | None = None, text_col: str = "text",
           count_col: str | None = "n_chars") -> DataFrame:
    """``df`` with every finding replaced by MASK; overlapping findings are masked as one.

    Only rows that a rule's pattern fits are joined with the ledger's findings.
    """
    rules = rules or RULES
    spark = df.sparkSession
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    update_ledger(df, ledger, "0", rules, text_col)
    text = F.col(text_col)
    clean = df.where(~has_candidate(text, rules))
    hit = df.where(has_candidate(text, rules)).withColumn("__blob", blob_id(text))
    masks = merged_spans(ledger.findings(rules)).withColumnRenamed("blob", "__blob")
    joined = hit.join(masks, "__blob", "left")
    # the text before each mask, then what follows the last one
    kept = F.transform(F.arrays_zip("__from", "__upto"),
                       lambda s: F.substring(text, s["__from"] + 1, s["__upto"] - s["__from"]))
    parts = F.concat(F.array_join(kept, MASK), F.lit(MASK), F.substring(text, F.col("__last") + 1, F.char_length(text)))
    masked = joined.withColumn(text_col, F.when(F.col("__last").isNull(), text).otherwise(parts))
    if count_col and count_col in df.columns:
        masked = masked.withColumn(count_col, F.when(F.col("__last").isNull(), F.col(count_col)).otherwise(
            F.char_length(F.col(text_col)).cast(df.schema[count_col].dataType)))
    return clean.unionByName(masked.select(*[F.col(c) for c in df.columns]))


def merged_spans(findings: DataFrame) -> DataFrame:
    """Per blob: where the text to keep before each merged span begins and ends, and the last span's end."""
    by_start = Window.partitionBy("blob").orderBy("start", "stop")
    reach = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    marked = findings.withColumn("reach", reach)
    opened = marked.withColumn("run", F.sum(F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1)
                                            .otherwise(0)).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    runs = opened.groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    before = F.coalesce(F.lag("stop").over(Window.partitionBy("blob").orderBy("run")), F.lit(0).cast("long"))
    gaps = F.sort_array(F.collect_list(F.struct("run", "before", "start")))
    return (runs.withColumn("before", before).groupBy("blob").agg(gaps.alias("gaps"), F.max("stop").alias("last"))
            .select("blob", F.col("gaps.before").cast("array<int>").alias("__from"),
                    F.col("gaps.start").cast("array<int>").alias("__upto"), F.col("last").cast("int").alias("__last")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_versions(table(spark, sf_dir, "documents"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind_at:int,kind:string,stop:bigint,base:boolean>>"))
    rows = found.select("path", spans.alias("spans"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda items: F.array_join(
        F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return rows.select(
        F.col("path").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


def _sql_rule(at: int, rule: Rule) -> str:
    pattern = (rule.plain or rule.pattern).replace("'", "''")
    return f"""
  select rid, {at} as kind_at, '{rule.name}' as kind, unnest(range(1, len(m) + 1)) as i, m, g, s,
         {rule.min_chars} as least, {'true' if rule.base else 'false'} as base
  from (select rid, regexp_extract_all(text, '{pattern}') as m, regexp_extract_all(text, '{pattern}', {rule.group}) as g,
               string_split_regex(text, '{pattern}') as s from d)"""


OP7_SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
f as ({' union all '.join(_sql_rule(i, r) for i, r in enumerate(RULES))}),
p as (
  select rid, kind_at, kind, base,
         list_sum(list_transform(s[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) as start,
         length(m[i]) as n
  from f where length(g[i]) >= least),
t as (select *, kind || ':' || start::bigint || ':' || (start + n)::bigint as span from p),
a as (
  select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
         count(*) filter (kind = 'hex') as n_hex,
         coalesce(string_agg(span, ',' order by start, kind_at) filter (base), '') as base_spans,
         string_agg(span, ',' order by start, kind_at) as spans
  from t group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (rid)
"""
