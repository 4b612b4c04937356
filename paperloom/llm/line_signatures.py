"""MinHash signatures of many lines at once, on numpy arrays.

A line's shingles are the windows of SHINGLE characters at every character; a shorter line is one.
Longer windows (WINDOW), which strangers seldom share, make the bands; lines with few shingles are
banded by the shingles too.  Every minimum has a hash of its own.
"""

from __future__ import annotations

import numpy as np

SHINGLE, WINDOW, BANDS, ROWS = 5, 8, 20, 3
#: Bands of lines that crowd into buckets of the first ones: by shingles, and with more rows.
CROWDED_BANDS, CROWDED_ROWS = 48, 8
#: Lines with FEW distinct shingles or less among the first SEEN are banded by shingles too.
SEEN, FEW = 24, 16
CHUNK = 1 << 16
_BASE, _MIX = 0xD1342543DE82EF95, np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(_BASE, j, 1 << 64) for j in range(WINDOW + 1)], np.uint64)
_draw = np.random.default_rng(20240817)
_XOR = _draw.integers(0, 1 << 32, CROWDED_BANDS * CROWDED_ROWS, dtype=np.uint32)
_ODD = _draw.integers(0, 1 << 31, CROWDED_BANDS * CROWDED_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TURN = _draw.integers(1, 1 << 63, (3, CROWDED_BANDS), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def characters(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and the length of each line."""
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, lines), np.int64, len(lines))


def windows(chars: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each line's windows, one line after another, and their number by line (1 at least)."""
    m = _mixed(chars.astype(np.uint64) + np.uint64(1))
    m = np.r_[m, np.zeros(width, np.uint64)]
    h, have, n = m, 1, len(chars)
    while have * 2 <= width:
        h = h[: len(h) - have] + h[have:] * _POWERS[have]
        have *= 2
    for j in range(have, width):
        h = h[: len(m) - j] + m[j:] * _POWERS[j]
    h = _mixed(h[:n])
    starts = np.cumsum(lengths) - lengths
    counts = np.maximum(lengths - width + 1, 1)
    for i in np.flatnonzero(lengths < width).tolist():
        a, k = int(starts[i]), int(lengths[i])
        h[a : a + 1] = _mixed((m[a : a + k] * _POWERS[:k]).sum(dtype=np.uint64, keepdims=True) + np.uint64(k))
    ends = np.cumsum(counts)
    return h[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)], counts


def buckets(hashes: np.ndarray, counts: np.ndarray, kind: int, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The buckets of each line, (lines, bands): hashes of ``rows`` minima each."""
    small, starts = (hashes >> np.uint64(32)).astype(np.uint32), np.cumsum(counts) - counts
    out = np.empty((len(counts), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(counts), _TURN[kind, b])
        for j in range(b * rows, b * rows + rows):
            h = _mixed(h ^ np.minimum.reduceat((small ^ _XOR[j]) * _ODD[j], starts))
        out[:, b] = h
    return out


def few(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of the lines with few distinct shingles among their first."""
    out, starts = counts <= SEEN, np.cumsum(counts) - counts
    long = np.flatnonzero(~out)
    first = np.sort(hashes[starts[long, None] + np.arange(SEEN)], axis=1)
    out[long] = (first[:, 1:] != first[:, :-1]).sum(1) + 1 <= FEW
    return np.flatnonzero(out)


def banded(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the line, bucket) of every band of every line; lines are not empty."""
    places, found = [], []
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and size < CHUNK:
            size += len(lines[end])
            end += 1
        chars, lengths = characters(lines[at:end])
        long, n = windows(chars, lengths, WINDOW)
        short, m = windows(chars, lengths, SHINGLE)
        some = few(short, m)
        for kind, where, b in ((0, np.arange(at, end), buckets(long, n, 0)), (1, some + at, _few_buckets(short, m, some))):
            places.append(np.repeat(where, BANDS))
            found.append(b.ravel())
        at = end
    return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def crowded(lines: list[str]) -> np.ndarray:
    """The buckets of each line in the bands for crowds, (lines, CROWDED_BANDS)."""
    out = [np.zeros((0, CROWDED_BANDS), np.uint64)]
    for at, end in _parts(lines, 1):
        hashes, counts = windows(*characters(lines[at:end]), SHINGLE)
        out.append(buckets(hashes ^ _TURN[2, 0], counts, 2, CROWDED_BANDS, CROWDED_ROWS))
    return np.concatenate(out)


def _few_buckets(hashes: np.ndarray, counts: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros((0, BANDS), np.uint64)
    starts, n = (np.cumsum(counts) - counts)[some], counts[some]
    ends = np.cumsum(n)
    return buckets(hashes[np.arange(ends[-1]) + np.repeat(starts - ends + n, n)], n, 1)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers of ``x`` in order: sorting takes a tenth of the time that np.unique's hash table does."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


def _sets(lines: list[str]) -> np.ndarray:
    """(place of the line, shingle) of every line's distinct shingles, as one sorted number: 16 bits and 48."""
    hashes, counts = windows(*characters(lines), SHINGLE)
    return _distinct(np.repeat(np.arange(len(lines), dtype=np.uint64), counts) << np.uint64(48) | hashes >> np.uint64(16))


def _parts(lines: list[str], step: int):
    """Ranges of lines, of multiples of ``step``, with about CHUNK characters each and no more than 2**15 lines."""
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and size < CHUNK and end - at < 1 << 15:
            size += sum(map(len, lines[end : end + step]))
            end += step
        yield at, end
        at = end


def shingle_hashes(lines: list[str]) -> list[np.ndarray]:
    """Each line's distinct shingles, as 64-bit hashes."""
    hashes, counts = windows(*characters(lines), SHINGLE)
    ends = np.cumsum(counts).tolist()
    return [_distinct(hashes[b - n : b].view(np.int64)) for b, n in zip(ends, counts.tolist(), strict=True)]


def alike(a: list[str], b: list[str]) -> np.ndarray:
    """Whether each pair of lines has shingle sets with a Jaccard of 3/4 or more."""
    both, out = [x for p in zip(a, b, strict=True) for x in p], np.zeros(len(a), bool)
    for at, end in _parts(both, 2):
        keys, n = _sets(both[at:end]), (end - at) // 2
        owner, shingle = keys >> np.uint64(49), keys & np.uint64((1 << 48) - 1)
        total = np.bincount(owner.astype(np.int64), minlength=n)
        paired = np.sort(owner << np.uint64(48) | shingle)
        common = np.bincount((paired[1:][paired[1:] == paired[:-1]] >> np.uint64(48)).astype(np.int64), minlength=n)
        out[at // 2 : end // 2] = 4 * common >= 3 * (total - common)
    return out
