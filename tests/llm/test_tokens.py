"""Token codes and packing: exact round trips and packing invariants."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meltlens.llm import packing as pk
from meltlens.llm import token_codes as tc
from meltlens.llm.common import scratch_path
from meltlens.llm.tokens import Encoder


def ids_of(name, text, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_encoding_is_the_library_s(name, rows):
    rng, encoder = random.Random(2), Encoder(public_tokenizers.path(name))
    signs = [" ", "  ", "\t", "\n", "\r", *map(chr, (0x0B, 0x1C, 0x85, 0xA0, 0x2003, 0x2028, 0x3000, 0x180E, 0x200B, 0x301)), "A", "b'll", "'s", "é",
             "ſ", "İ", "1", "٣", "½", ".", "!?", "語", "😀", "<|", "<|endoftext|>", "|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(5000)] + [t for _, t in rows] + [None]
    assert encoder.encode_all(texts) == [encoder.whole(t or "") for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_keeps_and_encodes_bounded_numbers_of_chunks(name, monkeypatch):
    monkeypatch.setattr("meltlens.llm.tokens.MAX_CACHED_CHUNKS", 600)
    monkeypatch.setattr("meltlens.llm.tokens.ENCODE_CHUNKS", 100, raising=False)
    rng, encoder, asked, held = random.Random(3), Encoder(public_tokenizers.path(name)), [], []

    class Library:
        def encode_batch_fast(self, texts, **options):
            asked.append(len(texts))
            held.append(len(encoder.cache) + len(getattr(encoder, "older", ())))
            return library.encode_batch_fast(texts, **options)

    library, encoder.tokenizer = encoder.tokenizer, Library()
    common = ["the", "of", "and", "naïve", "語"]
    batches = [[" ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("abcdefgh", k=7)) for _ in range(400))
                for _ in range(6)] for _ in range(8)]
    got = [encoder.encode_all(texts) for texts in batches]
    held.append(len(encoder.cache) + len(getattr(encoder, "older", ())))
    encoder.tokenizer = library
    assert got == [[encoder.whole(t) for t in texts] for texts in batches]
    assert max(asked) <= 100 and max(held) <= 2 * (600 + 100)


@pytest.mark.parametrize("top", [1, 255, 256, 50_256, 2**24, 2**32 - 1])
def test_codes_random_access(top):
    rng = np.random.default_rng(top)
    ids = (rng.random(3000) ** 4 * (top + 1)).astype(np.uint64).clip(0, top).astype(np.uint32)
    ids[[0, 511, 512, 2999]] = top
    codes = tc.Codes(tc.encode(ids))
    assert len(codes) == 3000 and [codes[i] for i in range(3000)] == ids.tolist()
    for a, b in rng.integers(0, 3001, (200, 2)):
        assert codes.slice(min(a, b), max(a, b)).tolist() == ids[min(a, b):max(a, b)].tolist()
    assert tc.Codes(tc.encode(ids[:0])).slice(0, 0).tolist() == []


def test_codes_of_documents(spark, docs, rows, empty):
    path = tc.write_codes(docs, scratch_path(spark, "codes-test"))
    got = tc.read_documents(spark, path, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += r.n_tokens
    want = sorted((str(i), ids_of("byte_bpe_50k.json", t, 2).tolist()) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    for r in random.Random(1).sample(got, 3):
        assert tc.token_at(spark, path, r.start) == r.ids[0]
    assert tc.token_at(spark, path, at) is None
    assert tc.read_documents(spark, tc.write_codes(empty, scratch_path(spark, "codes-test"))).count() == 0


def test_packing(spark, docs, rows, empty):
    placed = pk.place(pk.cut_pieces(docs, capacity=256), capacity=256)
    got = placed.collect()
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(ids_of("word_bpe_49k.json", t, 1))
    want = Counter((i, k // 256, k, ids[k:k + 256].tobytes()) for i, all_ids in texts.items() for ids in all_ids for k in range(0, len(ids), 256))
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got) == want
    used = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(used) <= best_fit_decreasing(Counter(r.length for r in got), 256)
    whole = {r.sequence_id: r.ids for r in pk.sequences(placed).collect()}
    for r in got:
        assert whole[r.sequence_id][r.offset:r.offset + r.length] == np.frombuffer(r.ids, dtype="<u4").tolist()
    assert pk.pack_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plans_use_every_piece_once(seed):
    rng = random.Random(seed)
    counts = dict(Counter(rng.choice([rng.randint(1, 64), 64, rng.randint(20, 40)]) for _ in range(rng.choice([0, 1, 5, 400]))))
    plan = pk.plan_packing(counts, 64)
    used = Counter()
    for pattern, times in plan:
        assert times >= 1 and 0 < sum(n * m for n, m in pattern.items()) <= 64
        for n, m in pattern.items():
            used[n] += m * times
    assert used == Counter(counts)
    bins = sum(t for _, t in plan)
    assert bins >= -(-sum(n * c for n, c in counts.items()) // 64)
    assert bins <= best_fit_decreasing(counts, 64)


def best_fit_decreasing(counts, capacity):
    gaps = []
    for n in sorted(Counter(counts).elements(), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_laid_out_in_parts(name, rows, monkeypatch):
    """Batches of a few characters: long texts are cut before spaces, and short ones share a batch."""
    monkeypatch.setattr("meltlens.llm.tokens.BATCH_CHARS", 40)
    encoder = Encoder(public_tokenizers.path(name))
    texts = [t for _, t in rows][:60] + ["x" * 500, "a  b \n  c" * 40, "", None]
    assert encoder.encode_all(texts) == [encoder.whole(t or "") for t in texts]
