"""Whole-text encoding with public tokenizers, by distinct chunks of a batch.

Both vocabularies split a text at white space and between letters and other signs
before their merges run, so the ids of a text are the ids of its chunks in order.
The chunk starts of a batch of texts are found with array operations, Arrow
encodes the chunks as a dictionary, and only its entries meet the ``tokenizers``
library (a bounded cache keeps their ids); one gather lays the ids out in order.
A worker holds the arrays of one batch, the encodings of one group of new chunks and
the cache, however long the texts and however many the chunks are.
Texts that hold the string of an added token are encoded as one piece, since such
a string can span chunks.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Unicode's White_Space characters beyond ASCII (with these, what the vocabularies' patterns call \s).
WIDE_SPACE = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
#: Code points below this with a class each; the Latin letters leave out the dotted capital I, whose lower case ends in a mark.
LATIN = 0x250
OTHER, LETTER, SIGN, QUOTE, DIGIT, SPACE = 0, 1, 2, 3, 4, 5


def _classes() -> np.ndarray:
    of = np.full(LATIN, OTHER, dtype=np.uint8)
    of[:0x80] = SIGN
    for first, last, kind in (("A", "Z", LETTER), ("a", "z", LETTER), ("\xC0", "\xD6", LETTER), ("\xD8", "\xF6", LETTER),
                              ("\xF8", "\u012F", LETTER), ("\u0131", "\u024F", LETTER), ("0", "9", DIGIT),
                              ("\x09", "\x0D", SPACE), (" ", " ", SPACE), ("'", "'", QUOTE)):
        of[ord(first):ord(last) + 1] = kind
    return of


CLASSES = _classes()
#: tokenizer file -> whether a word takes the one space before it.  Other white space stands alone
#: there, all but its last character; the other vocabulary drops white space.
SPACE_JOINS = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
#: Chunks in each of a cache's two generations.  When the recent one is full, it becomes the older one;
#: chunks met again move back, so the frequent ones stay.
MAX_CACHED_CHUNKS = 500_000
#: Chunks that the library encodes at once (an encoding takes far more memory than its ids).
ENCODE_CHUNKS = 4096
#: Code points that are laid out as arrays at once, unless a text without white space is longer.
BATCH_CHARS = 4_000_000
#: (chunks cached, code points at once) where executors hold the memory of other stages too: less memory, more CPU time.
LEAN = (300_000, 1_000_000)


def chunk_starts(points: np.ndarray, texts: np.ndarray, joins: bool) -> np.ndarray:
    """Whether a chunk starts at each code point of texts laid end to end, which start at ``texts``.

    A run of letters ends at an ASCII character, and a run of other ASCII signs or digits at an
    ASCII letter (not after an apostrophe, which may begin a contraction)."""
    kind = CLASSES[np.minimum(points, LATIN - 1)]
    wide = points >= 0x80
    far = np.flatnonzero(wide)
    beyond = points[far]
    kind[far[beyond >= LATIN]] = OTHER
    kind[far[np.isin(beyond, WIDE_SPACE)]] = SPACE
    first = np.zeros(len(points), dtype=bool)
    first[texts] = True
    space = kind == SPACE
    before, now = kind[:-1], kind[1:]
    start = first.copy()
    cut = (before == LETTER) & ~wide[1:] & (now != LETTER)
    cut |= ((before == SIGN) | (before == DIGIT)) & (now == LETTER) & ~wide[1:]
    cut |= space[1:] & ~space[:-1]
    leaves = space[:-1] & ~space[1:]
    if joins:
        leaves &= points[:-1] != 32
        last = space.copy()  # the last of several white-space characters before something else
        last[:-1] &= ~space[1:] & ~first[1:]
        last[-1:] = False
        last[1:] &= space[:-1]
        last &= ~first
        start |= last
    start[1:] |= cut | leaves
    return start


def little_endian(ids: list[int]) -> bytes:
    raw = array("I", ids)
    if sys.byteorder == "big":
        raw.byteswap()
    return raw.tobytes()


def segments(text: str, most: int) -> Iterator[str]:
    """A text in parts of about ``most`` characters that begin with a run of white space."""
    at = 0
    while len(text) - at > most:
        cut = RUN_START.search(text, at + most)
        if cut is None:
            break
        yield text[at:cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


#: A space after something that is no white space (of any kind).
RUN_START = re.compile(r"[^\s\x1C-\x1F](?= )")


class Encoder:
    def __init__(self, path: str, sizes: tuple[int, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.joins = SPACE_JOINS.get(os.path.basename(path))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cached_chunks, self.batch_chars = sizes or (MAX_CACHED_CHUNKS, BATCH_CHARS)
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return little_endian(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers; null is empty."""
        out: list[bytes] = []
        parts: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            for owner, ids in zip(owners, self._encode_parts(parts)):
                out[owner] += ids

        for text in texts:
            text = text or ""
            if self.joins is None or any(a in text for a in self.added):
                out.append(self.whole(text))
                continue
            out.append(b"")
            for part in segments(text, self.batch_chars):
                if not part:
                    continue
                if size + len(part) > self.batch_chars and parts:
                    flush()
                    parts, owners, size = [], [], 0
                parts.append(part)
                owners.append(len(out) - 1)
                size += len(part)
        flush()
        return out

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of non-empty texts of a batch."""
        if not parts:
            return []
        joined = "".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        texts = np.cumsum([0, *map(len, parts[:-1])])
        starts = np.flatnonzero(chunk_starts(points, texts, self.joins))
        data = joined.encode()
        offsets = np.append(starts, len(points))
        if len(data) != len(points):
            widths = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
            offsets = np.concatenate([[0], np.cumsum(widths)])[offsets]
        chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        found = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        place = coded.indices.to_numpy()
        counts = sizes[place]
        ends = np.cumsum(counts)
        # every id's place in ``flat``: the first of its chunk, and on
        shift = (np.cumsum(sizes) - sizes)[place] - (ends - counts)
        ids = flat[np.repeat(shift, counts) + np.arange(ends[-1])]
        bounds = np.append(np.searchsorted(starts, texts), len(starts))
        until = np.concatenate([[0], ends])[bounds]
        return [ids[a:b].tobytes() for a, b in zip(until[:-1], until[1:])]

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        found = list(map(self.cache.get, chunks))
        missing = [at for at, ids in enumerate(found) if ids is None]
        for first in range(0, len(missing), ENCODE_CHUNKS):
            if len(self.cache) >= self.cached_chunks:
                self.older, self.cache = self.cache, {}
            group = missing[first:first + ENCODE_CHUNKS]
            for at in group:
                found[at] = self.older.get(chunks[at])
            new = [at for at in group if found[at] is None]
            texts = [chunks[at].decode() for at in new]
            for at, coded in zip(new, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                found[at] = little_endian(coded.ids)
            self.cache.update((chunks[at], found[at]) for at in group)
        return found


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(tokenizer: str, sizes: tuple[int, int] | None = None) -> Encoder:
    """The worker's encoder of a tokenizer file, given by path or by its public name."""
    if (tokenizer, sizes) not in _ENCODERS:
        path = tokenizer
        if os.sep not in tokenizer:
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        _ENCODERS[tokenizer, sizes] = Encoder(path, sizes)
    return _ENCODERS[tokenizer, sizes]
