"""Similarity join of names by the ratio of their longest common subsequence.

Two names of n and m characters whose ratio 200 * LCS / (n + m) reaches a threshold have a common
subsequence of L or more: x = m - L characters at most are dropped from the target and y = n - L from the
name. A target cut into k pieces drops a characters of its i-th piece, and the name has b characters in
between those that match it; as the a add up to x and the b to y, one piece has weight * a + b of at most
(weight * x + y) / k, for any weight. So what is left of that piece, after dropping a, is a window
of the name after dropping b inside, near the piece's place: pairs meet by hashes of such rests, and those
that meet are compared in full. Rests are far longer than grams, so that few other pairs meet.

Targets are dealt by length and then, ``block`` at a time, to tasks; names go to all lengths that can
reach the threshold, ``SLICE`` at a time. In a task, names of one length choose the pieces and the weight
that cost least by the characters' frequencies, or are compared with all targets if that costs less.
Only the counts of lengths pass through the driver.

Names are compared as they are; null names are left out, repeated ones count once.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import ratio, ratio_of

BLOCK, SLICE = 1 << 16, 1 << 16
THRESHOLD = 85

#: Characters of a block at most, and names that are worth a slice of their own while tasks are few.
CHARACTERS, FEW = 1 << 22, 1 << 12

#: Names that are looked up, and pairs that are compared, at a time; samples for estimates of cost.
ROWS, PAIRS, SAMPLE = 1024, 1 << 20, 4096
#: Nanoseconds for looking up a rest and storing one; below DIRECT for all pairs, no pieces are chosen.
LOOK, STORE, DIRECT = 10.0, 150.0, 2e7
WEIGHTS = (0.5, 1.0, 1.5, 2.0, 3.0, 5.0)
#: Most rests of a length; pieces that have more are no choice.
MOST_RESTS = 5000
_R = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


def _codes(items: list[str]) -> np.ndarray:
    return np.frombuffer("".join(items).encode("utf-32-le"), np.uint32) if any(items) else np.zeros(0, np.uint32)


def _mixed(codes: np.ndarray) -> np.ndarray:
    """A 64-bit number of each character."""
    z = codes.astype(np.uint64) + np.uint64(_R)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """R ** c and R ** -c for c below the size, in 64 bits."""
    back = pow(_R, -1, 1 << 64)
    one, two = [1], [1]
    for _ in range(size):
        one.append(one[-1] * _R & _WORD)
        two.append(two[-1] * back & _WORD)
    return np.array(one, np.uint64), np.array(two, np.uint64)


@cache
def _dropped(size: int, count: int) -> np.ndarray:
    """Ways to drop so many of the characters, one a row."""
    return np.array(list(combinations(range(size), count)), np.int64).reshape(math.comb(size, count), count)


class _Rests:
    """Hashes of windows of equally long strings, some characters dropped; strings are columns."""

    def __init__(self, codes: np.ndarray, most: int):
        n = codes.shape[1]
        powers, self.back = _powers(n + most + 1)
        mixed = np.ascontiguousarray(_mixed(codes).T)
        zero = np.zeros((1, mixed.shape[1]), np.uint64)
        #: sums[d] has the sum up to a character as it counts after d dropped ones
        self.sums = [np.concatenate([zero, np.cumsum(mixed * (powers[:n] if d == 0 else np.concatenate([self.back[d:0:-1], powers[: max(0, n - d)]])[:n])[:, None], axis=0, dtype=np.uint64)]) for d in range(most + 1)]
        self.jumps = [self.sums[d][:-1] - self.sums[d + 1][1:] for d in range(most)]

    def of(self, start: int, stop: int, drop: np.ndarray) -> np.ndarray:
        """Ways x strings, for the window from start up to stop."""
        count = drop.shape[1]
        base = self.sums[count][stop] - self.sums[0][start]
        out = np.broadcast_to(base, (len(drop), base.size)) if not count else base + self.jumps[0][drop[:, 0]]
        for d in range(1, count):
            out = out + self.jumps[d][drop[:, d]]
        return out * self.back[start]


class _Table:
    """Hashes and the strings that they are of."""

    def __init__(self, hashes: list[np.ndarray]):
        keys = np.concatenate([h.ravel() for h in hashes])
        own = np.concatenate([np.tile(np.arange(h.shape[1], dtype=np.int32), h.shape[0]) for h in hashes])
        order = np.argsort(keys)
        self.keys, self.own = keys[order], own[order]
        self.shift = np.uint64(64 - max(10, math.ceil(math.log2(len(keys) + 1)) + 3))
        self.seen = np.zeros(1 << 64 - int(self.shift), bool)
        self.seen[keys >> self.shift] = True

    def met(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Strings that are looked up, and from where to where they meet others in ``own``."""
        hit = np.flatnonzero(self.seen[hashes >> self.shift])
        keys = hashes.ravel()[hit]
        low = np.searchsorted(self.keys[:-1], keys)
        some = self.keys[low] == keys
        hit, keys, low = hit[some], keys[some], low[some]
        return hit % hashes.shape[1], low, np.searchsorted(self.keys, keys, "right")


def _expanded(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) for each place from low up to high, about PAIRS at a time."""
    ends = np.cumsum(high - low)
    total, at = int(ends[-1]) if ends.size else 0, 0
    starts = ends - (high - low)
    while at < total:
        upto = min(total, at + PAIRS)
        first, last = np.searchsorted(ends, at, "right"), np.searchsorted(starts, upto, "left")
        a, b = np.maximum(starts[first:last], at), np.minimum(ends[first:last], upto)
        every = np.arange(at, upto)
        which = np.repeat(np.arange(first, last), b - a)
        yield rows[which], low[which] + (every - starts[which])
        at = upto


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """LCS of each row's two strings, bit-parallel."""
    if a.shape[1] < b.shape[1]:
        a, b = b, a
    m = b.shape[1]
    if not m:
        return np.zeros(len(a), np.int64)
    if m > 64:
        text = lambda x: np.ascontiguousarray(x).tobytes().decode("utf-32-le")
        total = a.shape[1] + m
        return np.array([round(ratio(text(x), text(y)) * total / 200) for x, y in zip(a, b)], np.int64)
    out, size = np.empty(len(a), np.int64), max(1, (1 << 22) // (a.shape[1] * m))
    full = np.uint64((1 << m) - 1)
    for k in range(0, len(a), size):
        bits = np.packbits(a[k : k + size, :, None] == b[k : k + size, None, :], axis=2, bitorder="little")
        hits = np.zeros((*bits.shape[:2], 8), np.uint8)
        hits[:, :, : bits.shape[2]] = bits
        hits = np.ascontiguousarray(hits.view("<u8")[:, :, 0].T)
        row = np.full(hits.shape[1], full)
        for hit in hits:
            u = row & hit
            row = (row + u | row - u) & full
        out[k : k + size] = m - np.bitwise_count(row).astype(np.int64)
    return out


class _Counts:
    """Characters of strings, whatever their order: how often the first four times of 32 kinds are there, and how many more."""

    def __init__(self, codes: np.ndarray):
        kinds = codes.astype(np.uint8) & 31
        self.words = np.zeros((2, len(codes)), np.uint64)
        self.more = np.zeros(len(codes), np.int64)
        for kind in range(32):
            count = (kinds == kind).sum(axis=1)
            self.words[kind // 16] |= ((np.uint64(1) << np.minimum(count, 4).astype(np.uint64)) - np.uint64(1)) << np.uint64(4 * (kind % 16))
            self.more += np.maximum(count - 4, 0)

    def common(self, at: np.ndarray, other: _Counts, there: np.ndarray) -> np.ndarray:
        """What the strings have in common at most."""
        out = np.minimum(self.more[at], other.more[there])
        for one, two in zip(self.words, other.words):
            out += np.bitwise_count(one[at] & two[there])
        return out


class _Targets:
    """Targets of one length, with their tables of rests."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.m = codes, codes.shape[1]
        some = codes[:SAMPLE]
        self.rests: _Rests | None = None
        self.counts = _Counts(codes)
        #: how often two targets have the same character in a place
        self.same = np.array([float((np.square(np.unique(c, return_counts=True)[1], dtype=float)).sum()) for c in some.T]) / len(some) ** 2
        self.tables: dict[tuple[int, int], list[_Table]] = {}
        self.cuts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def cut(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of k pieces that tell about as much each, and how often two targets have the same piece."""
        if k not in self.cuts:
            told = np.concatenate([[0.0], np.cumsum(1e-3 - np.log(self.same))])
            bounds = np.searchsorted(told, told[-1] * np.arange(k + 1) / k - 1e-9)
            bounds[0], bounds[-1] = 0, self.m
            some, often = self.codes[:SAMPLE], np.empty(k)
            for i, (start, stop) in enumerate(zip(bounds, bounds[1:])):
                _, counts = np.unique(_mixed(some[:, start:stop]) @ _powers(self.m)[0][: stop - start], return_counts=True)
                seen = float((counts * (counts - 1.0)).sum()) / max(1, len(some) * (len(some) - 1))
                often[i] = max(seen, float(np.prod(self.same[start:stop])))
            self.cuts[k] = bounds, often
        return self.cuts[k]

    def table(self, k: int, most: int) -> list[_Table]:
        if (k, most) not in self.tables:
            if self.rests is None or len(self.rests.jumps) < most:
                self.rests = _Rests(self.codes, most)
            bounds = self.cut(k)[0].tolist()
            while len(self.tables) > 1:  # the oldest goes
                del self.tables[next(iter(self.tables))]
            self.tables[k, most] = [_Table([self.rests.of(p, e, p + _dropped(e - p, a)) for a in range(most + 1)]) for p, e in zip(bounds, bounds[1:])]
        return self.tables[k, most]


def _cost(n: int, m: int) -> float:
    """Nanoseconds for comparing a pair: one of twenty, if longer than this tells, is compared by its subsequence."""
    return 50 + 0.05 * (0.6 * n * m if min(n, m) <= 64 else 5000 + 150.0 * (n + m))


def _plan(targets: _Targets, rows: int, n: int, x: int, y: int) -> tuple[int, list[tuple[int, int]]] | None:
    """Number of pieces and the (a, b) to look up that cost least, None to compare all."""
    m, count = targets.m, len(targets.codes)
    pair = _cost(n, m)
    least, best = rows * count * pair, None
    if least < DIRECT:
        return None
    for k in range(1, min(m, x + y + 1, 48) + 1):
        bounds, often = targets.cut(k)
        sizes = np.diff(bounds)
        seen = set()
        for weight in WEIGHTS:
            limit = (weight * x + y) / k + 1e-9
            drops = [(a, b) for a in range(min(x, int(limit / weight)) + 1) for b in range(min(y, int(limit - weight * a)) + 1)]
            most = max(a for a, _ in drops)
            if most >= sizes.min() or (tried := tuple(drops)) in seen:
                continue
            seen.add(tried)
            looks = meets = stores = 0.0
            for a, b in drops:
                left = sizes - a
                ways = [math.comb(max(0, w + b - 2), b) for w in left.tolist()]
                others = [math.comb(w, a) for w in sizes.tolist()]
                if max(ways) > MOST_RESTS or max(others) > MOST_RESTS:
                    looks = math.inf
                    break
                own = np.array(ways, float) * (x - a + y - b + 1)
                looks += own.sum()
                stores += sum(others) if b == 0 else 0
                meets += float((own * np.array(others, float) * often ** (left / sizes)).sum())
            cost = rows * looks * LOOK + rows * count * meets * pair + (0 if (k, most) in targets.tables else count * stores * STORE)
            if cost < least:
                least, best = cost, (k, drops)
    return best


def _meetings(targets: _Targets, own: np.ndarray, x: int, y: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, target) of names of one length, that may be in more than once."""
    n, m = own.shape[1], targets.m
    plan = _plan(targets, len(own), n, x, y)
    if plan is None:
        every = np.arange(len(own))
        yield from _expanded(every, np.zeros_like(every), np.full_like(every, len(targets.codes)))
        return
    k, drops = plan
    tables = targets.table(k, max(a for a, _ in drops))
    bounds = targets.cut(k)[0].tolist()
    for begin in range(0, len(own), ROWS):
        rests = _Rests(own[begin : begin + ROWS], max(b for _, b in drops))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for table, p, e in zip(tables, bounds, bounds[1:]):
            found = []
            for a, b in drops:
                width = e - p - a + b
                if b and width - b < 2:
                    continue  # a single character has none inside
                drop = _dropped(max(0, width - 2), b) + 1
                for start in range(max(0, p - (x - a), n - width - (m - e) - (y - b)), min(n - width, p + y - b, n - width - (m - e) + (x - a)) + 1):
                    found.append(table.met(rests.of(start, start + width, start + drop)))
            if found:
                one, two, three = (np.concatenate(z) for z in zip(*found))
                for r, at in _expanded(one, two, three):
                    held.append((begin + r, table.own[at]))
                    if sum(len(z) for z, _ in held) >= PAIRS:
                        yield tuple(np.concatenate(z) for z in zip(*held))
                        held = []
        if held:
            yield tuple(np.concatenate(z) for z in zip(*held))


def similar_pairs(names: list[str], targets: list[str], twice: int, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of names and of targets, which have one length, whose ratio is half of ``twice`` or more.

    With ``best``, those of each name with the highest rounded ratio, and the first such target.
    """
    m = len(targets[0])
    order = sorted(range(len(targets)), key=targets.__getitem__)
    held = _Targets(_codes([targets[k] for k in order]).reshape(len(targets), m))
    codes = _codes(names)
    sizes = np.array([len(s) for s in names], np.int64)
    # a character that no target has is always dropped
    kept = np.isin(codes, np.unique(held.codes))
    left = np.diff(np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(sizes)])])
    codes = codes[kept]
    starts = np.cumsum(left) - left
    rows: list[np.ndarray] = [np.zeros(0, np.int64)]
    others: list[np.ndarray] = [np.zeros(0, np.int64)]
    for size in np.unique(sizes).tolist():
        least = -(-twice * (size + m) // 400)  # the shortest subsequence
        for n in np.unique(left[sizes == size]).tolist():
            if least > min(n, m):
                continue
            at = np.flatnonzero((sizes == size) & (left == n))
            own = codes[starts[at][:, None] + np.arange(n)[None, :]]
            counts, keys = _Counts(own), [np.zeros(0, np.int64)]
            tops = np.full(len(at), -1, np.int64)
            for r, t in _meetings(held, own, m - least, n - least):
                some = counts.common(r, held.counts, t) >= least
                pairs = np.unique(r[some] * len(targets) + t[some])
                r, t = np.divmod(pairs, len(targets))
                common = _common(own[r], held.codes[t])
                reached = common >= least
                pairs, r, t, common = pairs[reached], r[reached], t[reached], common[reached]
                if best:  # rounded half up; targets are sorted, so the smaller place is the first
                    score = (400 * common + size + m) // max(1, 2 * (size + m))
                    np.maximum.at(tops, r, score * len(targets) + len(targets) - 1 - t)
                else:
                    keys.append(pairs)
            if best:
                r = np.flatnonzero(tops >= 0)
                t = len(targets) - 1 - tops[r] % len(targets)
            else:
                r, t = np.divmod(np.unique(np.concatenate(keys)), len(targets))
            rows.append(at[r])
            others.append(t)
    return np.concatenate(rows), np.array(order, np.int64)[np.concatenate(others)]


def similar_candidates(names: DataFrame, targets: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, best: bool = False) -> DataFrame:
    """name, target: pairs (once each) whose rounded ratio reaches the threshold.

    With ``best``, a name's best targets of each length and block, among which is the best of all.
    """
    twice = 2 * math.ceil(threshold) - 1
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = names.select("name").where("name is not null").distinct().withColumn("n", F.length("name"))
    b = targets.select(F.col("name").alias("target")).where("target is not null").distinct().withColumn("m", F.length("target"))
    sizes, others = ({r[0]: r[1] for r in rows.groupBy(rows.columns[1]).count().collect()} for rows in (a, b))
    every, near, met = sorted(others), {}, dict.fromkeys(others, 0)
    for n, count in sizes.items():
        # what the shorter one has is all that can be common
        ms = [m for m in every if 400 * min(n, m) >= twice * (n + m)]
        near[n] = (bisect_left(every, ms[0]) if ms else 0, len(ms))
        for m in ms:
            met[m] += count
    dealt = {}
    for m, count in met.items():
        if count:
            blocks = -(-others[m] // min(block, max(1, CHARACTERS // max(1, m))))
            dealt[m] = blocks, max(-(-count // SLICE), min(-(-count // FEW), -(-2 * parts // blocks)))
    if not dealt:
        return a.crossJoin(b).select("name", "target").limit(0)

    def held(pairs: dict[int, tuple[int, int]], key: str) -> tuple[Column, Column]:
        found = F.create_map(*(z for k, v in pairs.items() for z in (F.lit(k), F.array(*map(F.lit, v)))))[F.col(key)]
        return found[0], found[1]

    first, size = held(near, "n")
    blocks, slices = held(dealt, "m")
    upto = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    left = a.withColumn("m", F.explode(F.slice(F.array(*map(F.lit, every)), first + 1, size)))
    left = left.select("name", "m", F.pmod(F.xxhash64("name", F.lit(1)), slices).cast("int").alias("slice"), upto(blocks).alias("part"))
    right = b.where(blocks.isNotNull()).select("target", "m", F.pmod(F.xxhash64("target"), blocks).cast("int").alias("part"), upto(slices).alias("slice"))

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        own, found = one["name"].to_pylist(), two["target"].to_pylist()
        r, t = similar_pairs(own, found, twice, best) if own and found else ([], [])
        return pa.table({"name": pa.array([own[k] for k in r], pa.string()), "target": pa.array([found[k] for k in t], pa.string())})

    keys = ["m", "part", "slice"]
    # as many partitions as groups, within bounds: adaptive execution would put the few MB into one
    tasks = max(parts, min(8 * parts, sum(p * s for p, s in dealt.values())))
    one, two = (rows.repartition(tasks, *keys).groupBy(*keys) for rows in (left, right))
    return one.cogroup(two).applyInArrow(compare, "name string, target string")


def best_names(names: DataFrame, targets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rename plan: name, target, score of names whose best target (ties by name) reaches the threshold.

    Both listings are of files of one library. A name that is a target already stays as it is.
    """
    taken = targets.select("name").distinct()
    pairs = similar_candidates(names.join(taken.hint("merge"), "name", "left_anti"), targets, threshold, best=True)
    rows = pairs.withColumn("score", F.round(ratio_of("name", "target"), 0)).where(F.col("score") >= threshold)
    return rows.groupBy("name").agg(F.min_by("target", F.struct(-F.col("score"), F.col("target"))).alias("target"), F.max("score").alias("score"))
