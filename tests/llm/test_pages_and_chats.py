"""HTML extraction, quality classifier and quotation links."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meltlens.llm import html_extract as hx
from meltlens.llm import quality_classifier as qc
from meltlens.llm import quote_links as ql
from meltlens.llm.common import table

SF = "/root/testdata/sf0.001"

ARTICLE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><header>no</header>
<nav><ul><li><a href="/x">no</a></li></ul></nav><!-- no <p>no --><div class="cookie-notice">no</div><article><header><h1>Head &amp; line</h1>
<span class=meta>no</span></header><p>First <b>bold</b> &lt;tag&gt;<p>second&nbsp; line<br>more</p><aside>no</aside><ul><li>a<li>b</ul>
<div class="ad-box"><p>no</p></div><blockquote>quoted</blockquote><form><input value=no>no</form><section id="comments"><p>no</p></section>
</article><div>no</div><footer>&copy; no</footer></body></html>"""


def test_article_blocks(spark):
    texts = [None, "", "plain &amp; text", ARTICLE, "<article><p>cut &amp; off &am", "<article><p>x<script>no", "<article><p>y<!-- no", "<article>z<a hre",
             "<article><p>" + "long " * 50_000 + "</article>", ARTICLE]
    df = spark.createDataFrame([(k, "http://h.org/", t, 1) for k, t in enumerate(texts)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in hx.extract_text(df).collect()}
    want = "Head & line\nFirst bold <tag>\nsecond line more\na\nb\nquoted"
    assert got == {0: "", 1: "", 2: "plain & text", 3: want, 4: "cut & off &am", 5: "x", 6: "y", 7: "z", 8: ("long " * 50_000).strip(), 9: want}
    assert hx.extract_text(df.limit(0)).count() == 0


def test_containers_and_markup_of_articles(spark):
    """Words of a container don't take the article with it; quotes in bare values and formulas are read right."""
    kept = {
        '<main class="with-sidebar"><p>text one</p></main>': "text one",
        '<div class="page sidebar-right"><article><p>text two</p></article></div>': "text two",
        '<article class="share-holder-news"><p>text three</p></article>': "text three",
        '<article><section id="related-work"><h2>Head</h2><p>text four</p></section></article>': "Head\ntext four",
        "<article><p title=it's>text five</p><p>it's</p></article>": "text five\nit's",
        '<article><p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p></article>': "let x=1 be",
        '<article><p a="1>2" b=\'<p>\'>text six</p></article>': "text six",
        # chrome all the same
        '<article><p>own</p></article><div class="comments"><article class="comment"><p>no</p></article></div>': "own",
        '<article><p>own</p><section id="comments"><p>no</p></section><div class="related-posts"><p>no</p></div></article>': "own",
        '<article><p>own</p></article><aside><article><p>no</p></article></aside>': "own",
        '<article><p>own</p></article><div class="related"><article><p>no</p></article></div>': "own"}
    df = spark.createDataFrame([(k, f"http://h{k}.org/", "<body>" + h + "</body>") for k, h in enumerate(kept)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in hx.extract_text(df).collect()} == dict(enumerate(kept.values()))


def test_edited_copies_keep_what_they_share(spark):
    """Paragraphs that two edited copies have in common stay; a notice in otherwise different articles goes."""
    notice = "please accept all of our new terms before you read on today"
    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    paragraphs = [words(f"p{i}x", 40) for i in range(6)]
    page = lambda parts: "<article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>"
    rows = []
    for copy in range(4):
        mine = [p if i % 3 else p.replace(f"p{i}x{7 + copy} ", f"edit{copy} ") for i, p in enumerate(paragraphs)]
        rows.append((copy, mine))
    rows += [(10 + k, [words(f"own{k}a", 40), notice, words(f"own{k}b", 40)]) for k in range(4)]
    df = spark.createDataFrame([(k, "http://h.org/", page(parts)) for k, parts in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in hx.extract_text(df).collect()}
    assert got == {k: "\n".join(p for p in parts if p != notice) for k, parts in rows}


def test_repeated_runs_of_a_host_go(spark):
    """Without an article container, runs that different pages of the host share are boilerplate."""
    menu, legal = " ".join(f"m{k}" for k in range(9)), " ".join(f"l{k}" for k in range(20))
    page = lambda k: f"<body><div>{menu}</div><p>own {k} " + " ".join(f"w{k}_{i}" for i in range(12)) + f"</p><div>{legal} tail{k}</div></body>"
    rows = [(k, "http://a.org/" + str(k), page(k)) for k in range(5)] + [(9, "http://b.org/", page(9)), (10, "http://b.org/", page(9)), (11, None, page(11))]
    got = {r.page_id: r.text for r in hx.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(5):
        assert got[k] == f"own {k} " + " ".join(f"w{k}_{i}" for i in range(12)) + f"\ntail{k}"
    assert got[9] == got[10] and menu in got[9] and legal in got[9]  # one page twice repeats nothing
    assert menu in got[11]


def test_deep_and_broken_markup_ends():
    assert hx.Page("<div>" * 20_000 + "x").blocks[-1][1] == "x"
    assert hx.Page("<b<b<b" * 5_000).blocks == hx.Page("<b<b<b" * 5_000).blocks
    assert hx.Page("a < b > c").blocks == [(hx.OPEN, "a < b > c")]


def test_machine_matches_the_double_sum():
    """The sum-of-squares identity equals the sum over pairs."""
    rng = np.random.default_rng(1)
    machine = qc.Machine(0.3, rng.normal(size=qc.DIMS).astype(np.float32), rng.normal(size=(qc.DIMS, qc.RANK)).astype(np.float32))
    for text in ("a b c a\nd |", "", None):
        index, value = qc.vector(text)
        margin, _ = machine.margins(*qc.stack([(index, value)]))
        pairs = sum(float(machine.factors[i] @ machine.factors[j]) * x * y for n, (i, x) in enumerate(zip(index, value))
                    for j, y in list(zip(index, value))[:n])
        assert margin[0] == pytest.approx(0.3 + float(machine.linear[index] @ value) + pairs, abs=1e-3)
    again = qc.Machine.from_bytes(machine.to_bytes())
    assert np.array_equal(again.factors, machine.factors)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    machine = qc.train(docs, labels)
    scored = qc.score_documents(docs, machine).join(labels, "doc_id").where(qc.held_out(F.col("doc_id"))).collect()
    assert len(scored) > 80
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in scored) >= 0.97 * len(scored)
    assert qc.train(docs, labels).to_bytes() == machine.to_bytes()


def test_classifier_edge_cases(spark, docs, empty):
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    machine = qc.train(docs, none)
    scores = qc.score_documents(docs, machine).collect()
    assert len(scores) == docs.count() and {r.score for r in scores} == {0.5}
    ones = spark.createDataFrame([(k, 1) for k in range(100, 140)] + [(k, 7) for k in range(300, 310)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in qc.score_documents(docs, qc.train(docs, ones)).collect())
    assert qc.score_documents(empty, machine).count() == 0
    assert qc.train(empty, none).bias == 0


CHAT = [
    (1, 0, "u", "Hello there. How are you?\nI think it works."), (1, 1, "a", "On Monday X wrote:\n> How are you?\n> I think  it WORKS.\nFine thanks. Good day."),
    (1, 2, "u", "> > How are you?\n> Fine thanks.\nok then"), (1, 3, "a", "> unknown thing\nhm"), (1, 4, "u", ">ok then\nyes"), (1, None, "u", None),
    (None, 3, "u", "> Good day.\nx"), (2, 5, "u", "> Good day.\nother conversation"), (2, 6, "u", ""), (2, 6, "u", ""), (3, 0, "u", "same"), (3, 1, "u", "same"),
    (3, 2, "u", "> same\n" + "long " * 20_000)]


def test_quotes_link_to_their_originals(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in CHAT], "conv_id long, turn long, role string, text string, conv string, hash string")
    got = {(r.conv_id, r.turn): (r.parent_turn, r.thread_turn, r.n_passages, r.text) for r in ql.link_conversations(df).collect()}
    assert got[1, 0] == (None, 0, 0, CHAT[0][3])
    assert got[1, 1] == (0, 0, 1, "Fine thanks. Good day.")
    assert got[1, 2] == (1, 0, 2, "ok then")
    assert got[1, 3] == (None, 3, 1, "> unknown thing\nhm")
    assert got[1, 4] == (2, 0, 1, "yes")
    assert got[1, None] == (None, None, 0, "")
    assert got[None, 3] == (None, 3, 1, "> Good day.\nx") and got[2, 5] == (None, 5, 1, "> Good day.\nother conversation")
    assert got[3, 2] == (0, 0, 1, ("long " * 20_000).strip())
    assert ql.link_conversations(df).count() == len(CHAT) and ql.link_conversations(df.limit(0)).count() == 0


def brute_threads(said):
    """parent, root, passages, linked and text of every message of one conversation, by reading them all again."""
    def units(text):
        lines = [" ".join(line.split()) for line in text.lower().split("\n")]
        found = {u.strip() for part in [" ".join(lines), *lines] for u in re.findall("[^.!?]+[.!?]*", part)}
        return (found | set(lines)) - {""}

    def windows(text, sizes):
        words = re.findall(r"\w+", text.lower())
        return {tuple(words[k:k + n]) for n in sizes for k in range(len(words) - n + 1)}

    def blocks(text):
        out = []
        for line in text.split("\n"):
            mark = re.match(r"\s*((?:>[ \t]?)*)", line)
            level = mark[1].count(">")
            attribution = level and out and not out[-1][0] and re.fullmatch(r".*(wrote|said):\s*", out[-1][1][-1])
            if attribution and len(out[-1][1]) == 1:
                out[-1] = [level, out[-1][1], []]
            elif attribution:
                out.append([level, [out[-1][1].pop()], []])
                out[-2][2].pop()
            elif not out or out[-1][0] != level:
                out.append([level, [], []])
            out[-1][1].append(line)
            out[-1][2].append(line[mark.end():] if level else line)
        return [(level, "\n".join(raw), "\n".join(text)) for level, raw, text in out]

    split = [blocks(t) for t in said]
    own = ["\n".join(text for level, _, text in parts if not level).strip() for parts in split]
    known, rows = [units(t) for t in own], []

    def origin(k, text):
        asked = units(text)
        first = {u: min(i for i in range(k) if u in known[i]) for u in asked if any(u in known[i] for i in range(k))}
        votes = [(len(asked & known[i]), sum(at == i for at in first.values()), i) for i in range(k) if asked & known[i]]
        if votes:
            return max(votes)[2]
        n = min(5, len(re.findall(r"\w+", text)))
        asked = windows(text, [n]) if n else set()
        held = [asked & windows(own[i], range(1, 6)) for i in range(k)]
        first = [min(i for i in range(k) if w in held[i]) for w in asked if any(w in h for h in held)]
        votes = [(len(h), first.count(i), i) for i, h in enumerate(held) if h]
        return max(votes)[2] if votes and 2 * max(votes)[0] >= len(asked) else None

    for k, parts in enumerate(split):
        found = [origin(k, text) if level else None for level, _, text in parts]
        parent = max(((-parts[j][0], at) for j, at in enumerate(found) if at is not None), default=(0, None))[1]
        rows.append((parent, k if parent is None else rows[parent][1], sum(p[0] > 0 for p in parts),
                     sum(at is not None for at in found), "\n".join(p[1] for p, at in zip(parts, found) if at is None).strip()))
    return rows


def test_links_and_texts_against_brute_force(spark):
    """Whole conversations: nested quotes, parts of sentences, attributions, unknown quotes, prompts and comparisons."""
    rng = random.Random(8)
    sentence = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n)) + rng.choice([".", "!", "?", ""])
    extras = [">>> import os", "> 5 apples are enough", "on Monday ann wrote:", ">", "", "bob said:", " > w1 w2", ">\tW3   w4."]
    talks = {}
    for c in range(30):
        said = []
        for _ in range(rng.randrange(2, 12)):
            lines = []
            for _ in range(rng.randrange(1, 5)):
                kind = rng.random()
                if kind < 0.4 and said:
                    words = rng.choice(rng.choice(said).split("\n")).split(" ")
                    at = rng.randrange(len(words)) if rng.random() < 0.5 else 0
                    lines.append(rng.choice(["> ", ">", "> > "]) + " ".join(words[at:at + 8]))
                elif kind < 0.6:
                    lines.append(rng.choice(extras))
                else:
                    lines.append(" ".join(sentence(rng.randrange(1, 7)) for _ in range(rng.randrange(1, 3))))
            said.append("\n".join(lines))
        talks[c] = said
    rows = [(c, k, "u", t) for c, said in talks.items() for k, t in enumerate(said)]
    rng.shuffle(rows)
    got = {(r.conv_id, r.turn): (r.parent_turn, r.thread_turn, r.n_passages, r.n_linked, r.text) for r in ql.link_conversations(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = {(c, k): row for c, said in talks.items() for k, row in enumerate(brute_threads(said))}
    assert got == want
    assert any(r[3] for r in want.values()) and any(r[2] > r[3] for r in want.values())


def test_long_reply_chain(spark):
    rows = [(1, 0, "u", "message 0")] + [(1, k, "u", f"> message {k - 1}\nmessage {k}") for k in range(1, 40)]
    got = ql.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: (r.parent_turn, r.thread_turn) for r in got} == {0: (None, 0)} | {k: (k - 1, 0) for k in range(1, 40)}


def test_quoted_lines_and_parts_of_sentences_link(spark):
    texts = {
        1: ["buy milk\ncall Bob\nfix roof", "> call Bob\ndone"],
        2: ["def f(x):\n    return x + 1", "what?", "> return x + 1\nwhy one"],
        3: ["今天天气很好。我们去公园吧！然后回家。", "> 我们去公园吧！\n好的"],
        4: ["We should move the whole meeting to Friday because of the strike.", "no idea", "> the whole meeting to Friday\nfine", "> meeting with nobody\nhm"],
        5: ["Yes. Alpha one.", "Yes. Beta two. Gamma three.", "Yes. Beta two.", "> Yes. Beta two. Gamma three.\nok", "> Yes. Alpha one.\nok"],
        6: ["A b. C d.", "E f. G h.", "A b. C d. E f.", "> A b. C d. E f.\nok"],
        7: ["a wrapped sentence\ngoes on here.", "> a wrapped sentence goes\n> on here.\nok"],
        8: ["今天天气很好我们去公园", "> 我们去公园\n好"]}
    rows = [(c, k, "u", t) for c, said in texts.items() for k, t in enumerate(said)]
    got = {(r.conv_id, r.turn): r.parent_turn for r in ql.link_conversations(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = {(1, 1): 0, (2, 2): 0, (3, 1): 0, (4, 2): 0, (5, 3): 1, (5, 4): 0, (6, 3): 2, (7, 1): 0, (8, 1): 0}
    assert {k: p for k, p in got.items() if p is not None} == want and len(got) == len(rows)


def test_all_earlier_writers_vote(spark):
    """Against counting the units of every earlier message."""
    rng = np.random.default_rng(2)
    said = [". ".join(f"s{w}" for w in rng.choice(6, rng.integers(1, 5))) + "." for _ in range(40)]
    quotes = [". ".join(f"s{w}" for w in rng.choice(8, rng.integers(2, 5), replace=False)) + "." for _ in range(40)]
    rows = [(1, k, "u", f"> {q}\n{t}") for k, (q, t) in enumerate(zip(quotes, said))]
    got = {r.turn: r.parent_turn for r in ql.link_conversations(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    units = [set(ql.unit_hashes(t)) for t in said]
    for k, quote in enumerate(quotes):
        asked = set(ql.unit_hashes(quote))
        first = {h: min(i for i in range(k) if h in units[i]) for h in asked if any(h in u for u in units[:k])}
        votes = [(len(asked & units[i]), sum(at == i for at in first.values()), i) for i in range(k) if asked & units[i]]
        if votes:
            assert got[k] == max(votes)[2]


def test_notices_in_articles_go_and_copied_articles_stay(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    notice, other = words("notice", 12), words("advert", 9)
    own = lambda k: [words(f"p{k}x{j}y", 15) for j in range(4)]
    page = lambda blocks, tag="p": "".join(f"<{tag}>{b}</{tag}>" for b in blocks)
    rows = [(k, "http://a.org/", f"<article>{page([notice, *own(k), other])}</article>") for k in range(5)]
    near = [own(20), own(20)[:3] + [words("edited", 15)]]
    rows += [(20 + k, "http://b.org/", f"<article>{page(b)}</article>") for k, b in enumerate(near)]
    rows += [(30, "http://a.org/", f"<article>{page([notice])}</article>"), (31, "http://c.org/", f"<article>{page([notice, *own(31)])}</article>")]
    menu = words("menu", 10)
    rows += [(40 + k, "http://d.org/", page([menu, words(f"top{k}z", 9), *own(40)], "div")) for k in range(2)]
    rows += [(50 + k, "http://d.org/", page([menu, words(f"top{k + 5}z", 9), *own(50 + k)], "div")) for k in range(3)]
    got = {r.page_id: r.text for r in hx.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == "\n".join(own(k)) for k in range(5))
    assert [got[20], got[21]] == ["\n".join(b) for b in near] and got[30] == notice and notice in got[31]
    assert all("\n".join(own(40)) in got[k] and menu not in got[k] for k in (40, 41))
    assert all("\n".join(own(k)) in got[k] and menu not in got[k] for k in (50, 51, 52))
