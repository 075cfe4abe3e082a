"""Operator 5 - main text of web pages with a host suffix array.

A page is read into blocks.  Blocks inside menus, headers, footers, sidebars,
notices, adverts, forms, comments and scripts, or beside a page's article, are
page chrome; text blocks of an article container are firm; all others (of a page
without such a container, or untyped ones inside it) are open.  What is repeated decides
about the open ones: the token streams outside the firm blocks of all pages of
a host are laid out as suffixes, and a run of at least ``RUN`` tokens that also
begins a suffix of a different page is boilerplate.  Only unique runs of open
blocks are kept, together with the firm blocks.

Whole blocks of at least ``RUN`` tokens that stand on several pages of a host are
judged by the other blocks beside them.  Where these differ, the block is a notice:
it goes though it is firm, unless nothing else is left of its page.  Where they
agree, the pages are copies of one article, edited or not, and the block stays though its
runs are repeated.  Pages are compared by the ``SKETCH`` smallest hashes of their 5-word
shingles outside the block, and of each block's pages those that are furthest apart by
two orders of these.

Whether a suffix shares ``RUN`` tokens with another page's depends on its first
``RUN`` tokens alone, so the suffix array is needed to that depth only: suffixes
are grouped by (host, hash of these tokens) with map-side combining, and a
group with two different streams is a repeated run.  Longer repeats are covered
by their windows.  A host with a third of all pages is as many groups as it has
different runs.  Pages with equal streams are one page to this test.

Defined results: null or empty html has empty text; a null url belongs to the
empty host; repeated rows are extracted each for itself; extra columns are
ignored; an empty table gives an empty result.  Unclosed tags, comments and
scripts end with the page; a text cut inside a character reference keeps what
is there.
"""

from __future__ import annotations

import heapq
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_batches, stored, table
from .url_filter import split_url

#: Tokens of the shortest repeated run that counts as boilerplate.
RUN = 8
#: Stands between the blocks of a stream: runs do not cross blocks.
BREAK = "\x00"

#: Words of a shingle and shingles of a page by which pages are compared.
SHINGLE, SKETCH = 5, 64
#: Common shares of two pages' shingles below which they are different, and from which on they are copies.
DIFFERENT, EQUAL = 0.5, 0.8

CHROME, OPEN, FIRM, BESIDE = 0, 1, 2, 3
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|iframe|xmp|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/><]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^><])*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-z][^<>]*\Z", re.DOTALL | re.IGNORECASE)
WORTH = re.compile(r"""(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search
    section select summary table tbody td tfoot th thead tr ul""".split())
CHROME_TAGS = frozenset("""aside button canvas dialog fieldset footer form head header menu nav noscript object optgroup option
    search select svg template audio video""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FIRM_TAGS = HEADINGS | frozenset("article blockquote caption dd dt figcaption li main p pre section td th".split())
CHROME_WORDS = frozenset("""ad ads advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment
    comments consent contentinfo cookie cookies dialog disqus footer gdpr hidden login masthead menu modal nav navbar navigation
    newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply
    search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets complementary""".split())
MAIN_WORDS = frozenset("main article articlebody".split())


class Page:
    """Blocks (kind, text) of one page, in page order."""

    def __init__(self, raw: str, lift: bool = False):
        #: whether an article is no chrome by the words of what it stands in
        self.lift = lift
        self.hidden_article = False
        self.blocks: list[tuple[int, str]] = []
        self.text: list[str] = []
        #: open elements: (name, inside chrome, inside article, nearest block element)
        self.stack: list[tuple[str, bool, bool, str]] = []
        self.counts: Counter = Counter()
        self.state = (False, False, "")
        self.has_article = False
        at = 0
        for tag in TAG.finditer(raw):
            if tag.start() > at:
                self.text.append(entities.unescape(raw[at:tag.start()]))
            at = tag.end()
            if name := tag["name"]:
                if tag["end"]:
                    self.close(name.lower())
                else:
                    self.open(name.lower(), tag["rest"])
        if at < len(raw):
            self.text.append(entities.unescape(raw[at:]))
        self.flush()
        if self.has_article:  # then text beside it that names no purpose is chrome, too
            self.blocks = [(CHROME if k == BESIDE else k, t) for k, t in self.blocks]
        else:
            self.blocks = [(OPEN if k == BESIDE else k, t) for k, t in self.blocks]

    def flush(self) -> None:
        if self.text:
            if text := " ".join("".join(self.text).split()):
                chrome, article, block = self.state
                inside = FIRM if block in FIRM_TAGS else OPEN
                self.blocks.append((CHROME if chrome else inside if article else BESIDE, text))
                self.has_article |= article and not chrome
            self.text = []

    def enter(self) -> None:
        """Take over the state of the innermost open element."""
        state = self.stack[-1][1:] if self.stack else (False, False, "")
        if state != self.state:
            self.flush()
            self.state = state

    def pop_to(self, depth: int) -> None:
        for name, *_ in self.stack[depth:]:
            self.counts[name] -= 1
        del self.stack[depth:]

    def nearest(self, names: tuple[str, ...], barrier: frozenset[str]) -> int:
        """Depth of the innermost open element of these names, or -1 behind a barrier."""
        if not any(self.counts[n] > 0 for n in names):
            return -1
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] in names:
                return depth
            if self.stack[depth][0] in barrier:
                return -1
        return -1

    def open(self, name: str, rest: str) -> None:
        if name in VOID:
            if name == "hr":
                self.flush()
            elif name == "br":
                self.text.append(" ")
            return
        if name in BLOCK:
            self.flush()
            if (depth := self.nearest(("p",), BLOCK - {"p"})) >= 0:
                self.pop_to(depth)
            for names, barrier in SIBLINGS.get(name, ()):
                if (depth := self.nearest(names, barrier)) >= 0:
                    self.pop_to(depth)
        _, chrome, article, block = self.stack[-1] if self.stack else ("", False, False, "")
        if name in BLOCK:
            block = name
        words, names = describe(rest, name) if rest else (frozenset(), frozenset())
        if name in ("article", "main") or words & MAIN_WORDS:
            article = True
            if chrome and not any(tag in CHROME_TAGS for tag, *_ in self.stack):
                self.hidden_article = True
                chrome = not self.lift
        if name not in ("html", "body"):
            # a container of text is chrome by a whole name only: "comment", not "with-sidebar"
            told = names if name in ("article", "main") else words
            chrome = chrome or name in CHROME_TAGS or bool(told & CHROME_WORDS) and not words & MAIN_WORDS
            # the article's own title may stand in a header element
            if article and name in HEADINGS and not words & CHROME_WORDS and self.only_header_above():
                chrome = False
        self.stack.append((name, chrome, article, block))
        self.counts[name] += 1
        self.enter()

    def only_header_above(self) -> bool:
        """Whether a header inside an article is all that makes this place chrome."""
        for name, chrome, article, _ in reversed(self.stack):
            if not chrome:
                return True
            if name not in ("header", "hgroup", "div") or not article:
                return False
        return True

    def close(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
        if name == "br":
            self.text.append(" ")
        if self.counts[name] <= 0:
            return
        depth = self.nearest((name,), frozenset() if name in BLOCK else BLOCK)
        if depth >= 0:
            self.pop_to(depth)
        self.enter()


#: Opening one of these ends an open sibling, unless its container is nearer.
_LISTS, _TABLE = frozenset("ul ol menu dir".split()), frozenset(["table"])
SIBLINGS: dict[str, list[tuple[tuple[str, ...], frozenset[str]]]] = {
    "li": [(("li",), _LISTS)], "dt": [(("dt", "dd"), frozenset(["dl"]))], "dd": [(("dt", "dd"), frozenset(["dl"]))],
    "tr": [(("tr",), _TABLE)], "td": [(("td", "th"), _TABLE | {"tr"})], "th": [(("td", "th"), _TABLE | {"tr"})],
    "option": [(("option",), frozenset(["select"]))], "body": [(("head",), frozenset())]}


def describe(rest: str, tag: str) -> tuple[frozenset[str], frozenset[str]]:
    """Words of the attributes that tell what an element is, and their whole names.  A section's id is an anchor: whole only."""
    words: set[str] = set()
    names: set[str] = set()
    for name, value in WORTH.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(
                r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            words.add("hidden")
            names.add("hidden")
        elif name in ("class", "id", "role", "itemprop"):
            names.update(value.split())
            words.update(value.split() if tag == "section" and name == "id" else re.split(r"[^a-z0-9]+", value))
    return frozenset(words), frozenset(names)


def read_page(raw: str) -> Page:
    """The page; where every article stands in containers that only their words make chrome, these words don't count."""
    page = Page(raw)
    if not page.has_article and page.hidden_article:
        return Page(raw, lift=True)
    return page


def shingle_sketch(blocks: list[str], units: list[int | None]) -> list[dict]:
    """The SKETCH smallest hashes of a page's word shingles, each with the block it begins in."""
    found: dict[int, int | None] = {}
    for text, unit in zip(blocks, units):
        words = text.split()
        for i in range(max(len(words) - SHINGLE, 0) + 1):
            found.setdefault(xxhash.xxh32_intdigest(" ".join(words[i:i + SHINGLE]).encode("utf-8", "surrogatepass")), unit)
    return [{"at": h, "unit": found[h]} for h in heapq.nsmallest(SKETCH, found)]


def read_pages(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Columns id, url, host, text (pages without open blocks), blocks (the others), outside (tokens not firm), and
    units: hashes of the firm and open blocks in page order (null: too short to be judged), and sketch: shingles of these."""
    host, _ = split_url(F.col(url_col))
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)["id"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in row_batches(batches, 500):
            pages = [read_page(raw).blocks if raw else [] for raw in batch["html"]]
            loose = [any(k == OPEN for k, _ in page) for page in pages]
            out = batch[["id", "url", "host"]].copy()
            out["text"] = [None if is_open else "\n".join(t for k, t in page if k == FIRM) for page, is_open in zip(pages, loose)]
            out["blocks"] = [[{"kind": k, "text": t} for k, t in page] if is_open else None for page, is_open in zip(pages, loose)]
            out["units"] = [[block_hash(t) for k, t in page if k in (FIRM, OPEN)] for page in pages]
            out["sketch"] = [shingle_sketch([t for k, t in page if k in (FIRM, OPEN)], units) for page, units in zip(pages, out["units"])]
            out["outside"] = [f" {BREAK} ".join(t for k, t in page if k != FIRM).split() for page in pages]
            yield out

    schema = (f"id {kind}, url string, host string, text string, blocks array<struct<kind:int,text:string>>, "
              "units array<long>, sketch array<struct<at:long,unit:long>>, outside array<string>")
    return rows.mapInPandas(read, schema)


def block_hash(text: str) -> int | None:
    if text.count(" ") + 1 < RUN:
        return None
    return (xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) ^ (1 << 63)) - (1 << 63)


def judged_blocks(read: DataFrame) -> DataFrame:
    """Columns page, notices, copies: the blocks of a page (by the hash of its host and units) that are notices, or of
    copied articles.  Only blocks that stand on several pages meet the sketches."""
    known = F.filter("units", lambda u: u.isNotNull())
    pages = read.select("host", page_key().alias("page"), F.array_distinct(known).alias("units"), "sketch").where(F.size("units") > 0)
    each = pages.select("host", "page", F.explode("units").alias("unit"))
    repeated = (each.groupBy("host", "unit").agg(F.min("page").alias("a"), F.max("page").alias("b")).where("a <> b")
                .select("host", "unit"))
    shared = stored(each.join(repeated, ["host", "unit"]).distinct(), "shared")
    sketches = pages.join(shared.select("page").distinct(), "page", "left_semi").select("page", "sketch").dropDuplicates(["page"])
    others = F.filter("sketch", lambda s: ~s["unit"].eqNullSafe(F.col("unit")))
    sides = (shared.join(sketches, "page").select("host", "unit", F.transform(others, lambda s: s["at"]).alias("rest"))
             .where(F.size("rest") > 0))
    order = [F.struct(F.array_min("rest").alias("at"), "rest"), F.struct(F.xxhash64(F.array_max("rest")).alias("at"), "rest")]
    ends = sides.groupBy("host", "unit").agg(
        F.count("*").alias("n"), *[end(o).alias(f"{name}{k}") for k, o in enumerate(order) for name, end in (("low", F.min), ("high", F.max))])

    def share(k: int) -> F.Column:
        """Common part of the two pages that are furthest apart by order k."""
        a, b = F.col(f"low{k}.rest"), F.col(f"high{k}.rest")
        return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))

    least = F.least(share(0), share(1))
    verdict = ends.where("n > 1").select("host", "unit", (least < DIFFERENT).alias("notice"), (least >= EQUAL).alias("copy"))
    return (shared.join(verdict, ["host", "unit"]).groupBy("page")
            .agg(F.collect_set(F.when(F.col("notice"), F.col("unit"))).alias("notices"),
                 F.collect_set(F.when(F.col("copy"), F.col("unit"))).alias("copies")))


def page_key() -> F.Column:
    return F.xxhash64("host", "units")


def repeated_runs(pages: DataFrame, run: int = RUN) -> DataFrame:
    """Suffix groups (host, head) whose first ``run`` tokens stand in different streams of the host."""
    streams = pages.where(F.size("outside") >= run).select("host", "outside")
    suffixes = streams.select("host", F.xxhash64("outside").alias("stream"), F.explode(suffix_heads(run)).alias("head"))
    return (suffixes.where("head is not null").groupBy("host", "head").agg(F.min("stream").alias("a"), F.max("stream").alias("b"))
            .where("a <> b").select("host", "head"))


def suffix_heads(run: int) -> F.Column:
    """Hash of the first ``run`` tokens of every suffix; null where these reach into the next block."""
    def head(at: F.Column) -> F.Column:
        tokens = F.slice("outside", at, run)
        return F.when(~F.array_contains(tokens, BREAK), F.xxhash64(tokens))

    return F.transform(F.sequence(F.lit(1), F.size("outside") - run + 1), head)


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 run: int = RUN) -> DataFrame:
    """Columns: id, url, text - one row per page."""
    read = stored(read_pages(df, id_col, url_col, html_col), "pages")
    judged = stored(judged_blocks(read), "judged")
    firm = read.where("text is not null").select("id", "url", "text", "units", page_key().alias("page")).join(
        judged.where(F.size("notices") > 0).select("page", "notices"), "page", "left")
    parts = F.arrays_zip(F.split("text", "\n", -1).alias("text"), F.col("units").alias("unit"))
    left = F.filter(parts, lambda b: b["unit"].isNull() | ~F.array_contains("notices", b["unit"]))
    done = firm.select("id", "url", F.when(F.col("notices").isNull() | (F.size(left) == 0), F.col("text"))
                       .otherwise(F.array_join(left["text"], "\n")).alias("text"))
    loose = read.where("text is null").select(
        "id", "url", "host", "blocks", "outside", page_key().alias("judged"), F.sha2(F.to_json(F.struct("host", "blocks")), 256).alias("page"))
    heads = (loose.where(F.size("outside") >= run).select("page", "host", F.posexplode(suffix_heads(run)).alias("at", "head"))
             .join(repeated_runs(read, run), ["host", "head"]))
    covered = heads.groupBy("page").agg(F.collect_set("at").alias("starts"))  # bounded by the page's length

    @F.pandas_udf("string")
    def unique_text(blocks: pd.Series, starts: pd.Series, notices: pd.Series, copies: pd.Series) -> pd.Series:
        out = []
        for page, found, noted, copied in zip(blocks, starts, notices, copies):
            gone = {at + k for at in (found if found is not None else ()) for k in range(run)}
            noted, copied = (set(x) if x is not None else set() for x in (noted, copied))
            at, kept, firm_notices = 0, [], []
            for block in page:
                unit = block_hash(block["text"]) if block["kind"] in (FIRM, OPEN) else None
                if block["kind"] == FIRM:
                    (firm_notices if unit in noted else kept).append(block["text"])
                    continue
                words = block["text"].split()
                if block["kind"] == OPEN:
                    kept.append(block["text"] if unit in copied else " ".join(w for i, w in enumerate(words, at) if i not in gone))
                at += len(words) + 1
            out.append("\n".join(t for t in kept if t) or "\n".join(firm_notices))
        return pd.Series(out, dtype=object)

    decided = (loose.join(covered, "page", "left").join(judged.withColumnRenamed("page", "judged"), "judged", "left")
               .select("id", "url", unique_text("blocks", "starts", "notices", "copies").alias("text")))
    return done.unionByName(decided).withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract_text(table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))
