"""Whole batches of texts as flat arrays: hashes of runs and of windows without a Python loop over characters."""

from __future__ import annotations

import numpy as np

from kerbline.functions.ranges import slices  # noqa: F401

#: An odd base of the polynomial hash and the multipliers of a well-known 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSE = np.ones(1, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters its input over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def _series(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = _series(BASE, max(n, 2 * len(_POWERS)))
    return _POWERS[:n]


def inverse_powers(n: int) -> np.ndarray:
    global _INVERSE
    if len(_INVERSE) < n:
        _INVERSE = _series(pow(BASE, -1, 1 << 64), max(n, 2 * len(_INVERSE)))
    return _INVERSE[:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums of mixed codes: two of them give the hash of what lies between, see ``between``."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers(len(codes)), out=out[1:])
    return out


def between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end), the same for equal runs wherever they stand."""
    return mixed((prefix[end] - prefix[start]) * inverse_powers(len(prefix))[start] + (end - start).astype(np.uint64) * M2)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes of all members of the runs, one run after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)
