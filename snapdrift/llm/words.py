"""Words and windows of words as 64-bit hashes, computed for a whole text at a time.

Words are ``[^\\x20\\x09-\\x0D]+``. A hash is a polynomial over random values of
the bytes, found from running sums, so no word is ever made a Python object.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BLOCK = 1 << 16
_rng = np.random.default_rng(20_260_101)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLIERS = _rng.integers(1, 1 << 63, 64, dtype=U) * U(2) + U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    size = max(BLOCK + 1, 1 << (n - 1).bit_length() if n > 1 else 1)
    if size not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for base in (_BASE, inverse):
            p = np.full(size, base, U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers.clear()
        _powers[size] = both[0], both[1]
    return _powers[size]


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end."""
    space = np.empty(len(data) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[0::2], edge[1::2]


def _hashes(data: bytes) -> np.ndarray:
    starts, ends = spans(data)
    if not len(starts):
        return np.empty(0, U)
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word, in order; long texts are taken block by block, cut at white space."""
    if len(data) <= 4 * BLOCK:
        return _hashes(data)
    parts, at = [], 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_hashes(data[at:end]))
        at = end
    return np.concatenate(parts)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U)
    if k <= 8:
        out = words[:n] * _MULTIPLIERS[0]
        for i in range(1, k):
            out += words[i : i + n] * _MULTIPLIERS[i]
        return mix(out)
    parts, step = [], BLOCK
    for at in range(0, n, step):
        part = words[at : at + step + k - 1]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], out=total[1:])
        m = len(part) - k + 1
        parts.append(mix((total[k:] - total[:m]) * down[:m]))
    return np.concatenate(parts)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct ``k``-word shingles, sorted; the whole text as one if it is shorter; none without words."""
    if 0 < len(words) < k:
        return window_hashes(words, len(words)) + U(len(words))
    return np.unique(window_hashes(words, k))
