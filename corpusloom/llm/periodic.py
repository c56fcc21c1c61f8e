"""Periodic runs of words by the tandem-repeat method of Gusfield and Stoye.

A run is a stretch of consecutive words with smallest period q, at least ``max(least, 2 * q)`` words
long, that no neighbouring word extends keeping period q. Words have no ASCII white space in them;
they are numbered from 0 and compared byte by byte.

The texts of an Arrow batch are searched together, as one sequence of word codes that no two texts
share, with arrays in the place of a suffix tree: classes of all factors of 1, 2, 4, .. words give
the suffix array and longest common extensions, minima over it the previous occurrences.

1. The sequence is cut into Lempel-Ziv blocks. Extensions to both sides of the borders of blocks
   give the squares (a factor twice in a row) that cover the leftmost occurrence of every square.
2. The suffix link of a square leads to the one that starts a word later. Walks along them, to the
   end of the stretch that keeps the period, complete the vocabulary: the distinct squares, each
   an interval of the suffix array. Squares whose half is itself periodic are left out, as the
   shorter ones cover the same stretch.
3. The intervals hold all occurrences. Those of one period that start at consecutive words merge
   into runs.

All steps are linear but for logarithms. A text in which no ``least // 2`` consecutive words occur
twice has no run and is not searched further. A text is searched in one task, with some 400 bytes a word.

Null and empty texts have no words and no runs; repeated rows are searched each; any id will do, as
ids aren't read; an empty table gives an empty result. Other columns are carried along, except that
``runs`` and ``collapsed`` replace input columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches, trim
from .words import mix

LEAST = 12
#: Words that are searched together, but for longer texts.
TOGETHER = 1 << 17
RESULTS = ("runs", "collapsed")
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_NONE = np.empty((0, 3), np.int64)


class Codes(dict):
    """Numbers words in the order of their first look-up."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


class Factors:
    """Classes of equal factors of 1, 2, 4, .. symbols of a sequence, up to a length that no factor repeats."""

    def __init__(self, t: np.ndarray) -> None:
        n = len(t)
        order = np.argsort(t, kind="stable")
        rank, slots = np.empty(n, np.int32), np.arange(n)
        opens = np.append(True, t[order[1:]] != t[order[:-1]])
        self.levels: list[np.ndarray] = []
        width = 1
        while True:
            # a class is named by its first place in the order; classes of one are settled
            head = np.flatnonzero(opens)
            sizes = np.diff(np.append(head, len(slots)))
            rank[order[slots]] = np.repeat(slots[head], sizes)
            self.levels.append(rank)
            slots = slots[np.repeat(sizes > 1, sizes)]
            if not len(slots):
                break
            at = order[slots]
            first, second = rank[at], rank[at + width]
            by = np.argsort(first.astype(np.int64) * n + second, kind="stable")
            order[slots] = at[by]
            first, second = first[by], second[by]
            opens = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
            rank = rank.copy()
            width *= 2
        self.order, self.rank = order, rank

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that are the same from i and from j on (i <> j)."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that are the same up to and with i and j (i <> j)."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << k) + 1, j - (1 << k) + 1
            step = ((a >= 0) & (b >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])).astype(np.int64) << k
            i -= step
            j -= step
        return start - i


class Minima:
    """Least values of 1, 2, 4, .. consecutive places, to find the nearest place that falls below a bound."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def before(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The nearest place before ``at`` whose value is below ``bound``, else -1."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            a = at - (1 << k)
            at = np.where((a >= 0) & (self.levels[k][np.maximum(a, 0)] >= bound), a, at)
        return at - 1

    def after(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The nearest place from ``at`` on whose value is below ``bound``, else the number of places."""
        at, n = at.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            ok = at + (1 << k) <= n
            at = np.where(ok & (self.levels[k][np.where(ok, at, 0)] >= bound), at + (1 << k), at)
        return at


def _counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the items, its index once for each of its parts, and the parts' numbers from 0."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def blocks(t: Factors) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each is the longest factor that also starts earlier, else one symbol."""
    order = t.order
    low, at = Minima(order), np.arange(len(order))
    previous = np.zeros(len(order), np.int64)
    for near in (low.before(at, order), low.after(at + 1, order)):
        have = (near >= 0) & (near < len(order))
        i = order[have]
        previous[i] = np.maximum(previous[i], t.ahead(i, order[near[have]]))
    steps, starts, i, n = np.maximum(previous, 1).tolist(), [], 0, len(order)
    while i < n:
        starts.append(i)
        i += steps[i]
    return np.array(starts)


def _shortest(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row of each stretch, with its smallest period."""
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    first = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.empty(0, bool)
    return start[first], end[first], period[first]


def leftmost(t: Factors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the stretches about borders of blocks that hold a square."""
    h, word = blocks(t), t.levels[0]
    sizes = np.diff(np.append(h, len(word)))
    # squares about the end of a block, with a period of at most its length
    which, k = _counted(sizes[:-1])
    right = h[1:][which]
    left = right - k - 1
    same = word[left] == word[right]
    pairs = [(left[same], right[same])]
    # squares about the start of a block, which end in it or in the next one
    which, k = _counted(sizes + np.append(sizes[1:], 0))
    left = h[which]
    right = left + k + 1
    left, right = (x[(right < len(word)) & (left > 0)] for x in (left, right))
    same = (word[left] == word[right]) & (word[left - 1] == word[right - 1])
    pairs.append((left[same], right[same]))
    left, right = (np.concatenate(x) for x in zip(*pairs))
    ahead, behind, period = t.ahead(left, right), t.behind(left - 1, right - 1), right - left
    held = ahead + behind >= period
    return _shortest((left - behind)[held], (right + ahead)[held], period[held])


def runs_of(t: Factors, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs."""
    start, end, period = leftmost(t)
    if not len(start):
        return start, end, period
    # suffix links: from each square to the one a word later, as long as the period holds
    which, k = _counted(end - start - 2 * period + 1)
    at, length = start[which] + k, 2 * period[which]
    shared = np.zeros(len(t.order), np.int64)  # symbols in common with the suffix before in the order
    shared[1:] = t.ahead(t.order[:-1], t.order[1:])
    low = Minima(shared)
    place = t.rank[at].astype(np.int64)
    first, last = low.before(place + 1, length), low.after(place + 1, length)
    squares = np.unique(np.stack([first, last, length]), axis=1)
    which, k = _counted(squares[1] - squares[0])
    at, length = t.order[squares[0][which] + k], squares[2][which]
    by = np.lexsort((at, length))
    at, length = at[by], length[by]
    head = np.flatnonzero(np.append(True, (length[1:] != length[:-1]) | (at[1:] != at[:-1] + 1)))
    tail = np.append(head[1:], len(at)) - 1
    start, end, period = _shortest(at[head], at[tail] + length[head], length[head] // 2)
    long = end - start >= least
    return start[long], end[long], period[long]


def _suspects(codes: list[np.ndarray], least: int) -> np.ndarray:
    """The texts in which some ``least // 2`` consecutive words occur twice, by hashes: a few others may be among them."""
    size = max(1, least // 2)
    own = [k for k, x in enumerate(codes) if len(x) >= max(2, least)]
    if not own:
        return np.empty(0, np.int64)
    lengths = np.array([len(codes[k]) for k in own])
    text = np.repeat(np.array(own), lengths)
    x = mix(np.concatenate([codes[k] for k in own]).astype(np.uint64) + (text.astype(np.uint64) << np.uint64(32)) + np.uint64(1))
    windows = len(x) - size + 1
    h = np.zeros(windows, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : k + windows]
    inside = text[:windows] == text[size - 1 :]
    ordered = np.sort(h[inside])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.unique(text[:windows][inside & np.isin(h, twice)]) if len(twice) else np.empty(0, np.int64)


def find_runs(codes: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """Of each text, given as word codes, the runs (start, length, period) in order of start and period."""
    found = [_NONE] * len(codes)
    own = _suspects(codes, least)
    if not len(own):
        return found
    lengths = np.array([len(codes[k]) for k in own])
    begin = np.cumsum(lengths + 1) - lengths
    most = 1 + max(int(codes[k].max()) for k in own)
    # between texts, and at either end, a symbol that occurs once
    t = np.empty(int(lengths.sum()) + len(own) + 1, np.int64)
    t[0] = -1
    for k, (at, n) in enumerate(zip(begin, lengths)):
        t[at : at + n] = codes[own[k]] + k * most
        t[at + n] = -2 - k
    start, end, period = runs_of(Factors(t), least)
    text = np.searchsorted(begin, start, "right") - 1
    rows = np.stack([start - begin[text], end - start, period], axis=1)
    rows = rows[np.lexsort((period, start))]
    cuts = np.searchsorted(np.sort(text), np.arange(len(own) + 1))
    for k, which in enumerate(own):
        found[which] = rows[cuts[k] : cuts[k + 1]]
    return found


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """The words that no run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(depth[:-1]) == 0)


def _searched(texts: list[bytes], least: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Runs and collapsed text of each text."""
    words, codes, known, many = [], [], Codes(), 0

    def done() -> Iterator[tuple[np.ndarray, bytes]]:
        for own, runs in zip(words, find_runs(codes, least)):
            yield runs, b" ".join([own[k] for k in kept_words(len(own), runs)] if len(runs) else own)

    for text in texts:
        own = text.split()  # bytes: ASCII white space only
        words.append(own)
        codes.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
        many += len(own)
        if many >= TOGETHER:
            yield from done()
            words, codes, known, many = [], [], Codes(), 0
    yield from done()


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` with ``runs`` (word number, length and period of each, by start, then period) and ``collapsed``.

    ``collapsed`` has the words that no run contains after its first period, joined by one space.
    """
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c.lower() not in RESULTS]
    row, text = fresh(docs, "row", "text")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own], F.lit(True)).alias(row), F.coalesce("text", F.lit("")).cast("binary").alias(text))
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, collapsed = [], []
            for found, short in _searched(batch.column(1).to_pylist(), least):
                runs.append(found)
                collapsed.append(short.decode("utf-8", "replace"))
            offsets = np.cumsum([0, *map(len, runs)])
            flat = np.concatenate([_NONE, *runs])
            items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
            yield pa.record_batch([batch.column(0), lists, pa.array(collapsed, pa.string())], names=[row, *RESULTS])
        trim()

    schema = f"{row} {packed.schema[row].dataType.simpleString()}, runs {RUNS}, collapsed string"
    found = packed.mapInArrow(search, schema)
    return found.select(*[F.col(row).getField(c).alias(c) for c in own], *RESULTS)
