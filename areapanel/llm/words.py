"""Words of UTF-8 text batches as 64-bit hashes, by numpy over the Arrow buffers.

A word's hash is a polynomial over the random values of its bytes, so it does not depend on
where the word stands. Batches are worked through in slices of bounded size cut between
words, whatever the length of a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes between words. SPACES: \x20 and \x09-\x0D. MARKS: all ASCII but digits and letters.
#: NOT_LETTERS: all ASCII but letters.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
MARKS = np.zeros(256, bool)
MARKS[:0x80] = True
MARKS[0x30:0x3A] = MARKS[0x41:0x5B] = MARKS[0x61:0x7B] = False
NOT_LETTERS = MARKS.copy()
NOT_LETTERS[0x30:0x3A] = True

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        held = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """hashes of all words; starts[i] is the first word of text i (one more at the end); first/last: their bytes."""

    hashes: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    last: np.ndarray
    data: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.first[i]:self.last[i]].tobytes()


def split_words(texts: pa.Array, between: np.ndarray) -> Words:
    """Words of each text of a binary array; null texts have none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    hashes, firsts, lasts = [], [], []
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + SLICE_BYTES)
        if hi < len(data):  # end the slice before a separator, else at the next one
            cut = np.flatnonzero(between[data[lo:hi]])
            if len(cut) and cut[-1] > 0:
                hi = lo + int(cut[-1])
            else:
                while hi < len(data) and not between[data[hi]]:
                    later = np.flatnonzero(between[data[hi:hi + SLICE_BYTES]])
                    hi = hi + int(later[0]) if len(later) else min(len(data), hi + SLICE_BYTES)
        part = data[lo:hi]
        inside = ~between[part]
        edge = np.zeros(len(part) + 1, bool)
        own = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi, "right")]
        edge[own - lo] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | edge[1:-1]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * _power("up", _BASE, len(part)), out=total[1:])
        hashes.append(mix((total[e] - total[s]) * _power("down", _INVERSE, len(part))[s]) if len(s) else np.zeros(0, np.uint64))
        firsts.append(s + lo)
        lasts.append(e + lo)
        lo = hi
    first = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.searchsorted(first, offsets), first,
                 np.concatenate(lasts) if lasts else first, data)


def word_hash(word: bytes) -> int:
    """The hash of one word, equal to that inside a text."""
    out = split_words(pa.array([word], pa.binary()), np.zeros(256, bool)).hashes
    return int(out[0])


def blocks(texts: pa.Array, max_bytes: int):
    """(lo, hi) row ranges of at most max_bytes of text each, one row at least."""
    sizes = np.nan_to_num(np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), np.float64))
    lo, held = 0, 0.0
    for i, size in enumerate(sizes):
        if i > lo and held + size > max_bytes:
            yield lo, i
            lo, held = i, 0.0
        held += size
    if lo < len(sizes):
        yield lo, len(sizes)
