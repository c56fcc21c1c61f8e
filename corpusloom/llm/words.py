"""Words of texts as numpy arrays: code points, runs of them and 64-bit hashes of the runs, without a loop over words."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POINTS = 0x110000
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def lowered(text: str) -> str:
    """Lower case of the same length: the few letters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers[:] = [np.multiply.accumulate(np.full(size, f, np.uint64)) for f in (_ODD, pow(_ODD, -1, 1 << 64))]
    return _powers[0][:n], _powers[1]


def run_hashes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of every run of values; runs begin at ``first`` and end where the next begins."""
    if not len(first):
        return np.empty(0, np.uint64)
    up, down = _power(len(values))
    spread = mix(values.astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(spread * up, first) * down[first])


def table(test) -> np.ndarray:  # noqa: ANN001
    """A test of characters by code point."""
    return np.fromiter((test(chr(c)) for c in range(_POINTS)), bool, _POINTS)


def among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which codes are in a sorted array."""
    if not len(known):
        return np.zeros(len(codes), bool)
    maybe = np.zeros(1 << 16, bool)
    maybe[known >> np.uint64(48)] = True
    found = maybe[codes >> np.uint64(48)]
    k = np.flatnonzero(found)
    found[k] = known[np.minimum(np.searchsorted(known, codes[k]), len(known) - 1)] == codes[k]
    return found
