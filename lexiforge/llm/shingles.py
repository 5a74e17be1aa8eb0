"""Word shingles of whole texts as sets of 64-bit hashes, computed on byte arrays.

Words are runs without ASCII white space, in lower case. A shingle is five consecutive words; a text of one to
four words has one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SLICE = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the 0th, 1st, ... power modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """One hash for each word of lower-case UTF-8 text."""
    out, lo = [], 0
    while lo < len(data):
        hi = min(len(data), lo + _SLICE)
        while hi < len(data) and not _SPACE[data[hi]]:  # a slice ends at a word's end
            hi += 1
        b = np.frombuffer(data[lo:hi], np.uint8)
        gap = np.concatenate([[True], _SPACE[b], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(b)))])
        h = (sums[end] - sums[start]) * powers(_INVERSE, len(b) + 1)[start]
        out.append(mix(h ^ (end - start).astype(np.uint64)))
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    h = word_hashes(text.lower().encode()) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    k = min(words, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + h[j : len(h) - k + 1 + j]
    out = mix(out ^ np.uint64(k))
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]
