"""Vectorised words and word shingles of many texts at once, on numpy arrays.

A word is a run of bytes outside 0x20 and 0x09-0x0D; A-Z count as a-z.  A word's hash
is a polynomial over randomly mapped bytes, finished by a mixer.
"""

from __future__ import annotations

import numpy as np

K = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(64, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)], dtype=np.uint64)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * _MIX
    return h ^ (h >> np.uint64(32))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words in a byte array."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2] - edges[::2]


def word_hashes(texts: list[bytes], chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's offsets into them (one more than texts)."""
    out, counts = [], []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < chunk):
            size += len(texts[end]) + 1
            end += 1
        data = np.frombuffer(b"\n".join(texts[at:end]), np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[at:end])])
        starts, lengths = spans(data)
        counts.append(np.diff(np.searchsorted(starts, begins)))
        if len(starts):
            offsets = np.cumsum(lengths) - lengths
            flat = data[~_SPACE[data]]
            place = np.arange(len(flat)) - np.repeat(offsets, lengths)
            values = _BYTE[flat] * _power(int(lengths.max()))[place]
            out.append(mixed(np.add.reduceat(values, offsets) + lengths.astype(np.uint64)))
        at = end
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return hashes, np.cumsum(np.r_[0, np.concatenate(counts)]) if counts else np.zeros(1, np.int64)


def folded(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` words in one array of word hashes."""
    m = len(words) - k + 1
    h = np.full(max(m, 0), k, np.uint64)
    for j in range(k):
        h = mixed(h ^ words[j : j + m]) if m > 0 else h
    return h


def shingle_sets(texts: list[bytes], k: int = K, keep_bits: int = 48) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes of ``k`` words; fewer words make one shingle, none make none."""
    words, offsets = word_hashes(texts)
    windows = folded(words, k)
    mask = np.uint64((1 << keep_bits) - 1)
    sets = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        h = windows[a : b - k + 1] if b - a >= k else folded(words[a:b], b - a) if b > a else words[:0]
        h = np.sort(h & mask)
        sets.append(h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h)
    return sets
