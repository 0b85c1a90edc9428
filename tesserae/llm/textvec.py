"""Vectorised text kernels over Arrow string buffers.

A column of texts is handled as one byte buffer with offsets. Words, lines and n-grams get 64-bit hashes
from prefix sums, so that no Python code runs for a word. Memory is about 60 bytes for each byte of a chunk; a chunk
holds at most `limit` bytes, or one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
#: A random odd value for each byte, and the base of the polynomial with its inverse modulo 2**64.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_power = np.ones(1, np.uint64)
_unpower = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are not one of space, \t, \n, \v, \f, \r.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, *range(9, 14)]] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _unpower
    if len(_power) < n:
        size = max(n, 1 << 20)
        for name, base in (("_power", _BASE), ("_unpower", _INV)):
            a = np.full(size, np.uint64(base))
            a[0] = 1
            globals()[name] = np.cumprod(a, dtype=np.uint64)
    return _power, _unpower


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    offs = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(buf: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first index by text of the maximal runs of bytes with member[byte]; runs end with their text."""
    n = len(buf)
    inside = member[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    left = np.zeros(n, bool)
    left[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~left | edge[:n]))
    right = np.zeros(n, bool)
    right[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~right | edge[1:])) + 1
    return start, end, np.searchsorted(start, offs)


class Hasher:
    """64-bit hashes of byte ranges of one buffer, of which equal ranges have equal ones."""

    def __init__(self, buf: np.ndarray):
        power, self._un = _powers(len(buf) + 1)
        self._sum = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * power[: len(buf)], out=self._sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sum[end] - self._sum[start]) * self._un[start]
        return mix(h ^ ((end - start).astype(np.uint64) * _GRAM))


def grams(words: np.ndarray, first: np.ndarray, k: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of every text, by text and place; their first index by text; the word each starts at.

    whole: a text of 1 to k - 1 words gives one hash of all its words.
    """
    n = np.diff(first)
    count = np.maximum(n - k + 1, (n > 0).astype(n.dtype) if whole else 0)
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    start = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    size = np.repeat(np.minimum(n, k), count)
    h = np.zeros(len(start), np.uint64)
    q = 1
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    short = bool(whole and (n[n > 0] < k).any())
    for j in range(k):
        w = padded[start + j]
        h += (np.where(j < size, w, np.uint64(0)) if short else w) * np.uint64(q)
        q = q * int(_GRAM) % 2**64
    if short:
        h ^= mix(np.where(size < k, size, 0).astype(np.uint64))
    return mix(h), at, start


def sorted_sets(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of every text in ascending order, and their first index by text."""
    h = h.copy()
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo > 1:
            h[lo:hi].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[at[:-1][at[:-1] < len(h)]] = True
    total = np.zeros(len(h) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return h[keep], total[at]


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The set of k-word shingles of every text, A-Z lower-cased, words being runs of non-space bytes."""
    buf = LOWER[buf]
    start, end, first = spans(buf, offs, NON_SPACE)
    h, at, _ = grams(Hasher(buf)(start, end), first, k, whole=True)
    return sorted_sets(h, at)
