"""Word shingles of many documents at once, as sorted distinct 64-bit hashes per document."""

from __future__ import annotations

import numpy as np
import xxhash

from .columns import U64, mix

_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (lower-cased A-Z; words end at blanks and at the document's end) and its document."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    solid = ~_GAP[data]
    first = np.zeros(n + 1, bool)
    first[at] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(n)
    sums = np.zeros(n + 1, U64)
    np.cumsum((_LOWER[data].astype(U64) + U64(1)) * power[:n], out=sums[1:])
    return mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)), np.searchsorted(at, s, "right") - 1


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """A sorted array of distinct shingle hashes per document. Fewer than k words: the whole
    sequence is the one shingle; no word: an empty set."""
    words, doc = word_hashes(data, at)
    docs = len(at) - 1
    lo = np.searchsorted(doc, np.arange(docs + 1))
    rolled = words.copy()
    for j in range(1, k):
        m = len(words) - j
        if m > 0:
            rolled[:m] = mix(rolled[:m] * U64(0xA0761D6478BD642F) + words[j:])
    out = []
    for d in range(docs):
        a, b = lo[d], lo[d + 1]
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s if keep.all() else s[keep])
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes())], U64))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_digest(s: np.ndarray) -> int:
    """A signed 64-bit name of a set; 0 for the empty one."""
    if not len(s):
        return 0
    x = xxhash.xxh3_64_intdigest(s.tobytes()) | 1
    return x - (1 << 64) if x >> 63 else x
