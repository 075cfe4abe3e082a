"""Small documents with every kind of awkward row, and brute-force versions of the operators."""

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of another type.
CLASHING = ["id", "c", "n", "w", "row", "row_id", "rid", "part", "at", "words", "word", "tokens", "blob", "path", "spans", "kept",
            "n_words", "base_failed", "component_id", "root", "length", "start", "piece", "ids", "score", "host", "rule",
            "verdict", "blocks", "outside", "page", "conv", "parent", "text_id", "hit_words", "items", "met", "chosen"]


def sentence(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward_rows(rng):
    """(doc_id, text) with nulls, empty, blank, tiny, long, repeated and near-copied texts."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, "One Two\nthree  four"), (None, "x y z")]
    rows.append((7, sentence(rng, 30_000)))  # long
    shared = sentence(rng, 40)
    for i in range(40):
        rows.append((100 + i, sentence(rng, rng.randint(40, 120)) + (" " + shared if i % 2 else "")))
    base = sentence(rng, 150).split()
    for i in range(40):
        copy = list(base)
        for _ in range(i % 7):
            copy[rng.randrange(len(copy))] = sentence(rng, 1)
        rows.append((300 + i, " ".join(copy)))
    rows += [(400 + i, rows[-1][1]) for i in range(30)]  # exact copies
    rows += [rows[-1], rows[-1]]  # repeated rows
    rows.append((None, " ".join(base)))
    rows += [(500, "É é ÀB ab àb 1234 " * 20), (501, "word " * 60), (502, "AB!! CD!! " * 40), (503, "a|b#c " * 70)]
    return rows


def shingles(text):
    w = WORD.findall((text or "").translate(ASCII))
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_components(rows):
    """Per row: set size and smallest id reachable over links of 0.75 or more."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 4 >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


def brute_quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)"""
    text = text or ""
    w = WORD.findall(text)
    n = len(w)
    windows = [tuple(w[i:i + 3]) for i in range(n - 2)]
    counts = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(ch in "#*$%&|<>" for ch in text)
    failed = n < 50 or 100 * len(covered) > 50 * n
    letters = sum(ch.isalpha() for ch in text)
    bad = (symbols >= 0.1 * n or letters and sum(ch.isupper() for ch in text) >= 0.3 * letters
           or "!!" in text and sum(x.endswith("!!") for x in w) >= 0.1 * n
           or w and max(Counter(w).values()) >= 0.3 * n or not 2 * n <= sum(map(len, w)) <= 15 * n)
    return (n, sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed, not failed and not bad)


def brute_hits(text, items):
    """(n_words, hit positions, item ids) of a text against (id, text) items."""
    w = PLAIN.findall((text or "").translate(ASCII))
    hit, ids = set(), set()
    for item, benchmark in items:
        b = PLAIN.findall((benchmark or "").translate(ASCII))
        n = min(len(b), 13)
        windows = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                if item is not None:
                    ids.add(str(item))
    return len(w), sorted(hit), sorted(ids)


def brute_spans(text):
    """All (start, kind, stop) spans, in the order of the digest."""
    text, found = text or "", []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    for order, kind, pattern, least in (
            (1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", r"[0-9a-f]+", 24),
            (3, "private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0),
            (4, "provider_token", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|glpat-[A-Za-z0-9_-]{20,}", 0),
            (5, "jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0)):
        found += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return [(a, kind, b) for a, _, kind, b in sorted(found)]


def brute_mask(text):
    out, at = [], 0
    for a, _, b in brute_spans(text):
        if a > at or not out:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return text if not out else "".join(out) + text[at:]
