"""Quality rules scored by isolation forests.

Per document: counts of the rules (words, word characters, symbols, repeated lines, words in
repeated 3-word windows and more), and from them the rules' statistics, as they are: shares, lengths
and rates, without limits of their own. Every statistic has an isolation forest of its own, whose trees
split the range of their rows at random; short mean path lengths mark values that few documents have, at
either end. Every tree of a forest is grown on all documents, labelled or not. Labelled rows calibrate
a threshold for each forest: one after the other the forest that rejects most of the bad rows
left, a wrongly rejected good one counting as ten, until none gains ``LEAST`` of the bad rows; at most
``max_false`` of the good ones are rejected. Rows that the base rule fails take no part in the fit.

Nothing is sampled. Statistics are rounded down to ``STEPS`` steps an octave, so Spark counts all
documents, and all labelled rows still kept, by rule and step; the driver gets these counts alone, whose
number the range of the statistics bounds, not the number of rows. Without labelled rows of both
classes the base rule alone decides.

Nulls and empty texts have no words and fail the base rule; null ids are scored like others. Rows
that repeat get equal results. Other columns are carried along whatever their names; ``judge`` replaces
an input column named like a result column, ``accepted`` returns the input's columns untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, fresh, small_batches, trim, written

#: Steps that a statistic has between a power of two and the next.
STEPS = 512
TREES, HEIGHT = 64, 10
#: Scores tell path lengths in units of the mean one over so many rows; trees have all rows.
SUBSAMPLE = 256
#: Share of the bad rows that a further rule must reject.
LEAST = 0.005
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_letters", "n_upper", "n_digits", "n_marks", "n_distinct")
_SYMBOLS = "#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_DIGITS = b"0123456789"
_MARKS = b"!\"'()+,-./:;=?@[\\]^_`{}~"
RULES = ("symbols", "repeated lines", "repeated words", "upper case", "digits", "marks", "word length", "distinct words", "letters", "line length", "length")


def repeated_in_windows(words: list[bytes], n: int = 3) -> tuple[int, int]:
    """Words covered by n-word windows that occur twice or more; distinct words."""
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(words) < n + 1:
        return 0, len(ids)
    code, width = codes[: len(codes) - n + 1], max(2, len(ids))
    for k in range(1, n):
        if int(code.max()) >= (1 << 62) // width:  # keep exact: renumber before it could overflow
            code = np.unique(code, return_inverse=True)[1]
        code = code * width + codes[k : len(codes) - n + 1 + k]
    order = np.sort(code)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0, len(ids)
    hit = np.isin(code, twice)
    covered = np.zeros(len(codes), bool)
    for k in range(n):
        covered[k : len(codes) - n + 1 + k] |= hit
    return int(covered.sum()), len(ids)


def rule_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS and MORE of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the ASCII white space
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    repeat, distinct = repeated_in_windows(words)
    size = len(raw)
    without = lambda drop: size - len(raw.translate(None, drop))
    upper, lower = without(_UPPER), without(_LOWER)
    beyond = len(text) - without(bytes(range(128)))
    return (
        len(words), len(text) - sum(text.count(c) for c in ASCII_SPACE), sum(text.count(c) for c in _SYMBOLS), len(lines) - len(set(lines)), repeat,
        len(lines), upper + lower + beyond, upper, without(_DIGITS), without(_MARKS), distinct,
    )


def statistics(x: np.ndarray) -> np.ndarray:
    """The rules' statistics, one column each; x has the columns COUNTS + MORE."""
    words, chars, symbols, dup, repeat, lines, letters, upper, digits, marks, distinct = x.astype(np.float64).T
    per = lambda v, n: v / np.maximum(n, 1)
    return np.stack(
        [per(symbols, words), per(dup, lines), per(repeat, words), per(upper, letters), per(digits, chars), per(marks, chars), per(chars, words), per(distinct, words), per(letters, chars), per(words, lines), np.log1p(words)],
        axis=1,
    )


def steps(values: np.ndarray) -> np.ndarray:
    """Statistics (0 or more) as whole numbers in the same order: the leading bits of the float, STEPS an octave."""
    return np.ascontiguousarray(values, np.float64).view(np.int64) >> (52 - STEPS.bit_length() + 1)


def from_steps(own: np.ndarray) -> np.ndarray:
    """The least value of each step."""
    return (np.ascontiguousarray(own, np.int64) << (52 - STEPS.bit_length() + 1)).view(np.float64)


def expected_depth(n: int) -> float:
    """Mean path length of a random tree over n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Random trees over one statistic. A tree is a list of cuts with a path length for each range between them."""

    def __init__(self, values: np.ndarray, rng: np.random.Generator, times: np.ndarray | None = None) -> None:
        """``times`` counts the rows of each value; by default one each, in any order."""
        order = np.argsort(values, kind="stable")
        times = np.ones(len(values), np.int64) if times is None else times
        values, before = values[order], np.concatenate([[0], np.cumsum(times[order])])
        trees = []
        for _ in range(TREES):
            rng.permutation(len(values))  # drawn for the seeded stream alone: a tree has all rows, in any order
            trees.append(self._tree(values, before, rng))
        self.borders = np.unique(np.concatenate([cuts for cuts, _ in trees]))
        probes = np.append(-np.inf, self.borders)
        self.depths = sum(lengths[np.searchsorted(cuts, probes, side="right")] for cuts, lengths in trees) / len(trees)

    @staticmethod
    def _tree(values: np.ndarray, before: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """A tree over sorted values; ``before`` has the number of rows in front of each."""
        cuts: list[float] = []
        lengths: list[float] = []

        def grow(first: int, end: int, depth: int) -> None:
            low, high = values[first], values[end - 1]
            if depth == HEIGHT or low == high:
                lengths.append(depth + expected_depth(int(before[end] - before[first])))
                return
            at = max(rng.uniform(low, high), np.nextafter(low, high))
            middle = first + int(np.searchsorted(values[first:end], at, side="left"))
            grow(first, middle, depth + 1)
            cuts.append(at)
            grow(middle, end, depth + 1)

        grow(0, len(values), 0)
        return np.array(cuts), np.array(lengths)

    def score(self, values: np.ndarray) -> np.ndarray:
        """2 ** (-depth / expected depth): higher is more anomalous."""
        return 2.0 ** (-self.depths[np.searchsorted(self.borders, values, side="right")] / expected_depth(SUBSAMPLE))


class Model:
    """A forest for each rule, and the thresholds of those that reject."""

    def __init__(self, held: list[tuple[np.ndarray, np.ndarray]], seed: int) -> None:
        """``held`` has the steps of each rule's statistic and their numbers of rows."""
        rng = np.random.default_rng(seed)
        self.forests = [IsolationForest(from_steps(own), rng, times) for own, times in held]
        self.cuts: dict[int, float] = {}

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = from_steps(steps(x))
        return np.stack([f.score(x[:, k]) for k, f in enumerate(self.forests)], axis=1)

    def best_cut(self, k: int, own: np.ndarray, bad: np.ndarray, good: np.ndarray, room: float, n_bad: int, n_good: int) -> tuple[float, float, int]:
        """The value, threshold and wrongly rejected rows of the best threshold of a rule, by numbers of bad and good rows of each step."""
        scores, back = np.unique(self.forests[k].score(from_steps(own)), return_inverse=True)
        above = lambda n: (n.sum() - np.cumsum(np.bincount(back, n, len(scores))))[:-1]
        lost, false = above(bad), above(good)
        value = np.where(false <= room, lost / n_bad - 10 * false / n_good, -1.0)
        if not len(value):
            return -1.0, 0.0, 0
        at = int(value.argmax())
        return float(value[at]), float(scores[at] + scores[at + 1]) / 2, int(false[at])  # halfway between neighbouring scores

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest ratio of a score to its threshold (above 1: rejected), and the rule it is of."""
        if not self.cuts or not len(x):
            return np.zeros(len(x)), np.full(len(x), None, object)
        rules = sorted(self.cuts)
        ratio = self.scores(x)[:, rules] / np.array([self.cuts[k] for k in rules])
        top = ratio.argmax(1)
        return ratio[np.arange(len(x)), top], np.array(RULES, object)[np.array(rules)[top]]


def _counts_udf():  # noqa: ANN202
    fields = ", ".join(f"{c} long" for c in COUNTS + MORE)

    @F.pandas_udf(fields)
    def counts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rule_counts(t) for t in texts], columns=list(COUNTS + MORE))

    return counts.asNondeterministic()  # so that the planner never evaluates it twice


def _steps_udf():  # noqa: ANN202
    @F.pandas_udf("array<long>")
    def own(counts: pd.DataFrame) -> pd.Series:
        return pd.Series(list(steps(statistics(counts[list(COUNTS + MORE)].to_numpy()))))

    return own


def _by_step(rows: DataFrame, *sums: Column) -> dict[int, np.ndarray]:
    """For each rule its steps in order, one row each: step, number of rows, sums."""
    got = rows.select("*", F.posexplode("s").alias("rule", "step")).groupBy("rule", "step").agg(F.count(F.lit(1)).alias("n"), *sums).toPandas()
    return {k: own.drop(columns="rule").to_numpy(np.int64) for k, own in got.sort_values(["rule", "step"]).groupby("rule")}


def fit(docs: DataFrame, labels: DataFrame, failed: Column, max_false: float = 0.01, seed: int = 10) -> Model | None:
    """Forests from all documents, thresholds from all labelled ones; None without rows of both classes."""
    counted = docs.select("doc_id", _counts_udf()("text").alias("c")).select("doc_id", "c.*").where(~failed)
    every = written(counted.select("doc_id", _steps_udf()(F.struct(*COUNTS, *MORE)).alias("s")), "quality-steps")
    marks = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") > 0).alias("good"))
    known = written(every.join(marks, "doc_id").select("s", "good"), "quality-labelled")
    n_good, n_bad = (int(n or 0) for n in known.agg(F.sum(F.col("good").cast("long")), F.sum((~F.col("good")).cast("long"))).first())
    if not n_good or not n_bad:
        return None
    held = _by_step(every)
    model = Model([(held[k][:, 0], held[k][:, 1]) for k in sorted(held)], seed)
    room, left = max_false * n_good, known
    while True:
        table = _by_step(left, F.sum(F.col("good").cast("long")).alias("good"))
        found = [(*model.best_cut(k, own[:, 0], own[:, 1] - own[:, 2], own[:, 2], room, n_bad, n_good), k) for k, own in table.items() if k not in model.cuts]
        value, cut, false, k = max(found, key=lambda x: (x[0], -x[3]), default=(-1.0, 0.0, 0, 0))
        if value <= LEAST:
            return model
        model.cuts[k] = cut
        room -= false
        # the kept rows, by runs of kept steps
        own = table[k][:, 0]
        keep = own[model.forests[k].score(from_steps(own)) <= cut]
        runs = np.flatnonzero(np.diff(np.isin(own, keep).astype(int), prepend=0, append=0)).reshape(-1, 2)
        inside = [F.col("s")[k].between(int(own[i]), int(own[j - 1])) for i, j in runs]
        left = left.where(reduce(or_, inside, F.lit(False)))


def _failed(words: Column, repeated: Column, min_words: int, max_repeat_pct: int) -> Column:
    return (words < min_words) | (100 * repeated > max_repeat_pct * words)


def _judged(docs: DataFrame, labels: DataFrame, into: str, min_words: int, max_repeat_pct: int, max_false: float) -> DataFrame:
    """docs plus a struct of COUNTS, anomaly, rule."""
    spark = docs.sparkSession
    small_batches(spark)
    failed = _failed(F.col("n_words"), F.col("n_repeat_words"), min_words, max_repeat_pct)
    model = spark.sparkContext.broadcast(fit(docs, labels, failed, max_false))

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS) + ", anomaly double, rule string")
    def verdict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = model.value
        for texts in parts:
            counts = np.array([rule_counts(t) for t in texts], np.int64).reshape(len(texts), len(COUNTS + MORE))
            out = pd.DataFrame(counts[:, : len(COUNTS)], columns=list(COUNTS))
            out["anomaly"], out["rule"] = own.judge(statistics(counts)) if own is not None else (0.0, None)
            yield out
        trim()

    return docs.withColumn(into, verdict.asNondeterministic()("text"))


def judge(docs: DataFrame, labels: DataFrame, min_words: int = 50, max_repeat_pct: int = 50, max_false: float = 0.01) -> DataFrame:
    """docs plus COUNTS, anomaly, rule, base_failed, kept."""
    (into,) = fresh(docs, "rules")
    judged = _judged(docs, labels, into, min_words, max_repeat_pct, max_false)
    failed = _failed(F.col(f"{into}.n_words"), F.col(f"{into}.n_repeat_words"), min_words, max_repeat_pct)
    out = {c: F.col(f"{into}.{c}") for c in (*COUNTS, "anomaly", "rule")}
    return judged.withColumns(out | {"base_failed": failed, "kept": ~failed & (F.col(f"{into}.anomaly") <= 1)}).drop(into)


def accepted(docs: DataFrame, labels: DataFrame, min_words: int = 50, max_repeat_pct: int = 50, max_false: float = 0.01) -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns only."""
    (into,) = fresh(docs, "rules")
    judged = _judged(docs, labels, into, min_words, max_repeat_pct, max_false)
    failed = _failed(F.col(f"{into}.n_words"), F.col(f"{into}.n_repeat_words"), min_words, max_repeat_pct)
    return judged.where(~failed & (F.col(f"{into}.anomaly") <= 1)).drop(into)
