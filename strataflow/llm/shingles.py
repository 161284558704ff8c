"""Word shingles of texts as 64-bit hashes, by numpy on whole batches of texts."""

from __future__ import annotations

import numpy as np

from .common import LOWER_AZ, mix64

_rng = np.random.default_rng(20240607)
#: A random odd multiplier for words, one for shingles, and a random number for each byte.
_BASE, _STEP = (int(x) | 1 for x in _rng.integers(1 << 62, 1 << 63, 2, dtype=np.int64))
_BYTES = _rng.integers(0, np.iinfo(np.int64).max, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


_powers_of: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, ... base^(n-1) mod 2^64; kept for the longest text so far."""
    out = _powers_of.get(base)
    if out is None or len(out) < n:
        out = np.full(max(1 << 14, 1 << (n - 1).bit_length()), base, np.uint64)
        out[0] = 1
        _powers_of[base] = out = np.cumprod(out)
    return out[:n]


def inverse_powers(base: int, n: int) -> np.ndarray:
    return powers(pow(base, -1, 1 << 64), n)


def word_spans(data: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words [^\\x20\\x09-\\x0D]+ of the bytes, in order: hashes (A-Z as a-z, if lower), starts, ends.

    A word's hash is a polynomial in its bytes, from differences of one running sum (mod 2^64, odd base)."""
    x = np.frombuffer(data.translate(LOWER_AZ) if lower else data, np.uint8)
    if not len(x):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = np.ones(len(x) + 2, bool)
    space[1:-1] = _SPACE[x]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_BYTES[x] * powers(_BASE, len(x)), out=total[1:])
    return mix64((total[end] - total[start]) * inverse_powers(_BASE, len(x) + 1)[start] + (end - start).astype(np.uint64)), start, end


def word_starts(data: bytes) -> np.ndarray:
    """Where the words of word_spans() begin."""
    space = np.ones(len(data) + 1, bool)
    space[1:] = _SPACE[np.frombuffer(data, np.uint8)]
    return np.flatnonzero(space[:-1] & ~space[1:])


def word_hashes(data: bytes) -> np.ndarray:
    return word_spans(data)[0]


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """Distinct hashes, ascending, of runs of `width` words; of the whole sequence if there are fewer; none without words."""
    words = word_hashes(data)
    if not len(words):
        return words
    width_here = min(width, len(words))
    n = len(words) - width_here + 1
    out = np.zeros(n, np.uint64)
    for k in range(width_here):
        out = out * np.uint64(_STEP) + words[k : k + n]
    if width_here < width:
        out += np.uint64(width_here)
    out = np.sort(mix64(out))
    keep = np.ones(n, bool)
    keep[1:] = out[1:] != out[:-1]
    return out[keep]
