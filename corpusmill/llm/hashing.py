"""64-bit hashes of byte strings and word runs, computed for whole arrays at once.

The sum of b[i] * P**i over a run, modulo 2**64, comes from one running sum over the
bytes, and is moved to a common origin by the inverse power of the odd P.
"""

from __future__ import annotations

import numpy as np

P = 0x9E3779B97F4A7C15
P_INVERSE = pow(P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers.clear() if len(_powers) > 8 else None
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over the higher and lower ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def nonzero(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as signed numbers, 0 as 1."""
    return np.where(x == 0, np.uint64(1), x).view(np.int64)


def prefix_sums(values: np.ndarray, base: int = P) -> np.ndarray:
    """One more element than values: the weighted sums of all prefixes."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = P) -> np.ndarray:
    """Mixed hash of each run [start, end) of what prefix_sums has read; the length is part of it."""
    inverse = P_INVERSE if base == P else pow(base, -1, 1 << 64)
    found = (sums[end] - sums[start]) * powers(inverse, len(sums))[start]
    return mixed(found + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes without ASCII white space."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: bytes) -> np.ndarray:
    """Hash of every word of a UTF-8 text."""
    start, end = word_bounds(raw)
    return run_hashes(prefix_sums(np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)), start, end)
