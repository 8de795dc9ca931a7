"""Word shingle sets of whole texts, hashed in vectorised passes over Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from peakloom.llm.common import mix64, slices, text_buffers

WIDTH = 5
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MIXERS = np.array([mix64(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(64)], np.uint64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2^64 and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 21)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = []
        for b in (_BASE, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0][:n], _powers[1][:n]


def word_hashes(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in body, and for each text its first word's number (one more at the end).

    bounds: byte offsets of the texts within body. A-Z count as a-z.
    """
    n = len(body)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    low = _LOWER[body]
    solid = ~_SPACE[low]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = bounds[:-1][bounds[:-1] < n]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * inverse[starts] ^ (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(col: pa.Array) -> Iterator[np.ndarray]:
    """For each text, in order, the sorted distinct 64-bit hashes of its five-word shingles.

    With fewer words the whole sequence is the one shingle; a text without words (or null) has none.
    """
    body, offsets = text_buffers(col)
    for a, b in slices(offsets):
        lo = offsets[a]
        words, at = word_hashes(body[lo : offsets[b]], offsets[a : b + 1] - lo)
        n = max(0, len(words) - WIDTH + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(WIDTH):
            rolled += words[k : k + n] * _MIXERS[k]
        rolled = mix64(rolled)
        for i in range(b - a):
            s, e = at[i], at[i + 1]
            if e - s >= WIDTH:
                yield np.unique(rolled[s : e - WIDTH + 1])
            elif e > s:
                yield mix64(np.array([(words[s:e] * _MIXERS[8 : 8 + e - s]).sum() + np.uint64(e - s)], np.uint64))
            else:
                yield words[:0]
