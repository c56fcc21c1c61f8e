"""Fuzzy string ratios by longest common subsequences, bit-parallel in Python's integers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from .udfs import arrow_function


def _positions(s: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(s):
        out[c] = out.get(c, 0) | 1 << k
    return out


def _lcs(where: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence: zeros that are left in the row after all of ``other``."""
    full = (1 << size) - 1
    row = full
    for c in other:
        if (hit := where.get(c)) is not None:
            u = row & hit
            row = (row + u | row - u) & full
    return size - row.bit_count()


def ratio(a: str | None, b: str | None) -> float:
    """100 * 2 * LCS / (both lengths)."""
    if a is None or b is None:
        return 0.0
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * _lcs(_positions(a), len(a), b) / total


def _prefix_scores(short: str, where: dict[str, int], other: str) -> float:
    """The best ratio of ``short`` with a proper prefix of ``other``, all from one pass."""
    n = len(short)
    full = (1 << n) - 1
    row, best = full, 0.0
    for size, c in enumerate(other[: n - 1], 1):
        if (hit := where.get(c)) is not None:
            u = row & hit
            row = (row + u | row - u) & full
            best = max(best, 200.0 * (n - row.bit_count()) / (n + size))
    return best


def partial_ratio(a: str | None, b: str | None, cutoff: float = 0.0) -> float:
    """The best ratio of the shorter string with any window of the longer one, of its length or cut at an end.

    0 if that is below the cutoff. A window's common subsequence changes by one at most from start to
    start, so two windows bound all between them, and spans that can't be better are left out.
    """
    if a is None or b is None:
        return 0.0
    short, long = sorted((a, b), key=len)
    if not long:
        return 100.0
    if not short:
        return 0.0
    if short in long:
        return 100.0
    n, last = len(short), len(long) - len(short)
    where = _positions(short)
    at: dict[int, int] = {}

    def measure(k: int) -> int:
        if k not in at:
            at[k] = _lcs(where, n, long[k : k + n])
        return at[k]

    ends = 0.0
    # a window cut at an end has no longer subsequence than the whole one there, which bounds its ratio
    if 200.0 * measure(0) / (n + measure(0)) >= cutoff:
        ends = _prefix_scores(short, where, long)
    if 200.0 * measure(last) / (n + measure(last)) >= cutoff:
        backward = {c: int(f"{bits:0{n}b}"[::-1], 2) for c, bits in where.items()}
        ends = max(ends, _prefix_scores(short, backward, long[::-1]))
    least = math.ceil(max(ends, cutoff) * n / 100.0 - 1e-9)  # what a whole window has to reach
    top = max(at.values())
    spans = [(0, last)]
    while spans:
        low, high = spans.pop()
        bound = (at[low] + at[high] + high - low) // 2
        if high - low < 2 or bound < least or bound <= top:
            continue
        middle = (low + high) // 2
        top = max(top, measure(middle))
        spans += [(low, middle), (middle, high)]
    best = max(ends, 100.0 * top / n)
    return best if best >= cutoff else 0.0


#: Characters of the grams that tell texts apart before they are compared.
GRAM = 4


def grams(text: str) -> frozenset[str]:
    return frozenset(text[k : k + GRAM] for k in range(len(text) - GRAM + 1))


def may_reach(n: int, short: frozenset[str], long: frozenset[str], cutoff: float) -> bool:
    """Whether a partial ratio of the cutoff is possible for a string of n characters, by its grams in the longer one.

    A character that the common subsequence drops from the string destroys GRAM of its grams at most, and
    one that the window has in between GRAM - 1. For windows of w characters that is
    GRAM (n - L) + (GRAM - 1) (w - L) with L = cutoff (n + w) / 200, linear in w, which lies between
    the L that it must hold and n.
    """
    def lost(w: float) -> float:
        common = cutoff * (n + w) / 200.0
        return GRAM * (n - common) + (GRAM - 1) * (w - common)

    most = max(lost(n), lost(cutoff * n / (200.0 - cutoff)))
    return most >= len(short) or len(short - long) <= most + 1e-6


@arrow_function("double")
def ratio_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype=float)


@arrow_function("double")
def partial_ratio_of(a: pd.Series, b: pd.Series, cutoff: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x, y, c) for x, y, c in zip(a, b, cutoff)], dtype=float)
