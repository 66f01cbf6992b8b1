"""Words of UTF-8 texts and their hashes, found for a whole buffer of texts at once.

A word is a run of bytes other than the ASCII white space 0x09-0x0D and 0x20. Its
64-bit hash is a polynomial in random byte values, taken from prefix sums modulo
2**64, and mixed; equal words have equal hashes in every task.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240607)
_BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED_VALUE = _BYTE_VALUE.copy()
_FOLDED_VALUE[65:91] = _BYTE_VALUE[97:123]
_IS_SPACE = np.zeros(256, np.int8)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_BASE = 0x9E3779B97F4A7C15
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Texts are hashed in parts of about so many bytes, cut between words.
PART = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting integers beats a hash table here."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have, step = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while have < n:
            more = min(have, n - have)
            out[have : have + more] = out[:more] * step
            have += more
            step = step * step
    return out


class _Tables:
    up = np.zeros(0, np.uint64)
    down = np.zeros(0, np.uint64)

    @classmethod
    def cover(cls, n: int) -> None:
        if len(cls.up) < n:
            size = max(n, PART + (1 << 16))
            cls.up, cls.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)


def find_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of every word."""
    space = np.ones(len(data) + 2, np.int8)
    space[1:-1] = _IS_SPACE[data]
    step = np.diff(space)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def hash_words(data: np.ndarray, first: np.ndarray, last: np.ndarray, fold: bool = False) -> np.ndarray:
    """The hash of each word; with ``fold``, A-Z count as a-z."""
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        begin = int(first[at])
        to = max(at + 1, int(np.searchsorted(last, begin + PART, "right")))
        end = int(last[to - 1])
        _Tables.cover(end - begin)
        with np.errstate(over="ignore"):
            values = (_FOLDED_VALUE if fold else _BYTE_VALUE)[data[begin:end]]
            values *= _Tables.up[: end - begin]
            sums = np.zeros(end - begin + 1, np.uint64)
            np.cumsum(values, out=sums[1:])
            a, b = first[at:to] - begin, last[at:to] - begin
            out[at:to] = mix((sums[b] - sums[a]) * _Tables.down[a] + (b - a).astype(np.uint64) * _C[0])
        at = to
    return out
