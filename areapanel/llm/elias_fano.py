"""Elias-Fano sequences over numpy arrays, with vectorised access and search.

A sorted sequence below a bound is cut into `width` low bits, packed, and high parts in unary: a
one for each value, a zero at the end of each high part. A directory counts the ones before every
512 bits, so that finding the i-th one or zero touches a few words.
"""

from __future__ import annotations

import numpy as np

WORDS = 8
_ONE = np.uint64(1)


def pack_low(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each value, one after the other, as bytes (8 spare bytes at the end)."""
    out = np.zeros((len(values) * width + 7) // 8 + 8, np.uint8)
    if width:
        for lo in range(0, len(values), 1 << 16):  # 2**16 * width bits: whole bytes
            part = values[lo:lo + (1 << 16)]
            bits = (part[:, None] >> np.arange(width, dtype=np.uint64)) & _ONE
            packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
            at = lo * width // 8
            out[at:at + len(packed)] = packed
    return out


def unpack_low(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.int64) * width
    byte = bit >> 3
    word = np.zeros(len(at), np.uint64)
    for k in range(8):
        word |= data[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return (word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)


class EliasFano:
    """Arrays `low`, `high`, `ones` of n values below `bound`."""

    def __init__(self, n: int, bound: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bound, self.low, self.high, self.ones = n, bound, low, high, ones
        self.width = width_of(n, bound)

    @staticmethod
    def build(values: np.ndarray, bound: int) -> EliasFano:
        values = values.astype(np.uint64)
        width = width_of(len(values), bound)
        parts = (values >> np.uint64(width)).astype(np.int64)
        buckets = ((bound - 1) >> width) + 1 if bound else 1
        bits = np.zeros(-(-(len(values) + buckets + 1) // (64 * WORDS)) * 64 * WORDS, bool)
        bits[parts + np.arange(len(values))] = True
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        per_block = np.bitwise_count(high).reshape(-1, WORDS).sum(1, dtype=np.uint32)
        ones = np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32)
        return EliasFano(len(values), bound, pack_low(values, width), high, ones)

    def _select(self, rank: np.ndarray, bit: int) -> np.ndarray:
        """Position of the rank-th (from 0) one or zero."""
        rank = rank.astype(np.int64)
        blocks = np.arange(len(self.ones), dtype=np.int64)
        before = self.ones.astype(np.int64) if bit else blocks * (64 * WORDS) - self.ones
        block = np.searchsorted(before, rank, "right") - 1
        left = rank - before[block]
        word = block * WORDS
        found = np.zeros(len(rank), bool)
        at = word.copy()
        rest = left.copy()
        for k in range(WORDS):
            value = self.high[np.minimum(word + k, len(self.high) - 1)]
            count = np.bitwise_count(value).astype(np.int64)
            if not bit:
                count = 64 - count
            here = ~found & (rest < count)
            at[here] = word[here] + k
            rest = np.where(found | here, rest, rest - count)
            found |= here
        value = self.high[np.minimum(at, len(self.high) - 1)]
        if not bit:
            value = ~value
        place = np.zeros(len(rank), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            half = np.bitwise_count(value & np.uint64((1 << step) - 1)).astype(np.int64)
            up = rest >= half
            rest = np.where(up, rest - half, rest)
            value = np.where(up, value >> np.uint64(step), value)
            place += np.where(up, step, 0)
        return at * 64 + place

    def get(self, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.int64)
        part = (self._select(at, 1) - at).astype(np.uint64)
        return (part << np.uint64(self.width)) | unpack_low(self.low, at, self.width)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it is absent: successor search inside the bucket of its high part."""
        values = values.astype(np.uint64)
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        part = (values >> np.uint64(self.width)).astype(np.int64)
        lo = np.where(part > 0, self._select(np.maximum(part - 1, 0), 0) - np.maximum(part - 1, 0), 0)
        hi = self._select(part, 0) - part
        last = hi.copy()
        wanted = values & np.uint64((1 << self.width) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            middle = (lo[open_] + hi[open_]) >> 1
            less = unpack_low(self.low, middle, self.width) < wanted[open_]
            lo[open_[less]] = middle[less] + 1
            hi[open_[~less]] = middle[~less]
            open_ = open_[lo[open_] < hi[open_]]
        out = np.full(len(values), -1, np.int64)
        inside = np.flatnonzero(lo < last)
        same = unpack_low(self.low, lo[inside], self.width) == wanted[inside]
        out[inside[same]] = lo[inside[same]]
        return out


def width_of(n: int, bound: int) -> int:
    return max(0, min(56, (bound // max(n, 1)).bit_length() - 1))


def to_bytes(arrays: list[np.ndarray]) -> list[bytes]:
    """A count and the length of each array, then the arrays, each at a multiple of 8 bytes."""
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64).tobytes()
    parts = [head]
    for a in arrays:
        parts += [np.ascontiguousarray(a).tobytes(), b"\0" * (-a.nbytes % 8)]
    return parts


def from_bytes(data: np.ndarray, types: list) -> list[np.ndarray]:
    count = int(data[:8].view(np.int64)[0])
    sizes = data[8:8 * (count + 1)].view(np.int64)
    out, at = [], 8 * (count + 1)
    for size, kind in zip(sizes.tolist(), types):
        out.append(data[at:at + size].view(kind))
        at += size + (-size % 8)
    return out
