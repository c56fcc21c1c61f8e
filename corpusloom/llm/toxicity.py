"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding lower-cases, maps homoglyphs and accented letters to base letters, undoes digit and sign
substitutions inside words, and drops zero-width characters. The lexicon holds words and word
beginnings (``stem*``) with weights. Weights are log odds of a term in toxic against other labelled
rows; a seed list of common insults has a default weight where the labelled rows lack a term. Words
are runs of letters of any script; scripts written without spaces have pairs and triples of
characters as terms. Hits count at word starts only (anywhere in unspaced scripts), the heaviest
term of a place once, and not within an exception phrase: a given one, or two words around a hit
that labelled rows show to be harmless. The sum of weights and its ratio to the length go through a
logistic function fitted on the labels.

Terms, weights, learnt exceptions and the function are fitted on a bounded sample of labelled rows:
``FIT_ROWS`` in hash order, and at most ``LEXICON`` terms and as many exceptions, documented
parameters. Whole texts are scored.

Null and empty texts have no hits and get the score of a text without hits. Without labels of both
classes the seed list and a fixed function score. Repeated rows get equal results, other columns
are carried along; an input column named like a result column is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

FIT_ROWS, LEXICON = 20_000, 4_000
SEED_WEIGHT = 3.0
#: Fewest toxic rows that a learned term occurs in, and least odds against other rows.
MIN_ROWS, MIN_ODDS = 6, 8.0
PREFIXES = (4, 5, 6, 7)

# Seed insults and phrases in which they are harmless.
SEEDS = tuple("idiot idiots moron morons stupid pathetic worthless loser losers scum trash disgusting clown imbecile dumbass bastard asshole bitch retard vermin".split())
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "clown fish", "class clown", "pond scum", "soap scum", "stupid question", "sore loser")
# Characters that look like Latin letters.
HOMOGLYPHS = dict(
    zip(
        "абвгеёзикмнорстухѕіјԁԛԝһʟɡɑαβεικνορτυχωℓøðþłı",
        "abbreezikmhopctyxsijdqwhlgaabeiknoptuxwlodplI".lower(),
    )
)
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e"})
_ZERO_WIDTH = re.compile("[­​-‏⁠﻿]")
_NEEDS_LEET = re.compile(r"[a-z][0-9@$€]|[0-9@$€][a-z]")
_LEET_WORD = re.compile(r"[a-z0-9@$€]*(?:[a-z][0-9@$€]|[0-9@$€][a-z])[a-z0-9@$€]*")
_BANG = re.compile(r"(?<=[a-z])[!|](?=[a-z])")
# Thai and Lao, Burmese, Khmer, Japanese kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff"
_UNSPACED_CHAR = re.compile(f"[{_UNSPACED}]")
_WORD = regex.compile(rf"(?V1)[{_UNSPACED}]++|[\p{{L}}--[{_UNSPACED}]][[\p{{L}}\p{{M}}]--[{_UNSPACED}]]*+")
_SPELLED = re.compile(r"(?<![a-z])(?:[a-z][.\-_*]){2,}[a-z](?![a-z])")


class _Fold(dict):
    """A character's folded form, worked out when it first comes up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in HOMOGLYPHS:
            out = HOMOGLYPHS[c]
        else:
            base = unicodedata.normalize("NFKD", c)
            out = "".join(HOMOGLYPHS.get(x, x) for x in base.lower() if not unicodedata.combining(x)) or ("" if unicodedata.combining(c) else c)
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    text = (text or "").lower()
    if not text.isascii():
        text = _ZERO_WIDTH.sub("", text).translate(_FOLD)
    if _NEEDS_LEET.search(text):
        text = _LEET_WORD.sub(lambda m: m[0].translate(LEET), text)
    if "!" in text or "|" in text:
        text = _BANG.sub("i", text)
    return _SPELLED.sub(lambda m: re.sub(r"[^a-z]", "", m[0]), text) if re.search(r"[.\-_*][a-z][.\-_*]", text) else text


def _unspaced(c: str) -> bool:
    return not c.isascii() and _UNSPACED_CHAR.match(c) is not None


def _joins(c: str) -> bool:
    """Part of a word of a script that has spaces."""
    return c.isalpha() if c.isascii() else (c.isalpha() or unicodedata.category(c)[0] == "M") and not _unspaced(c)


def terms_of(folded: str) -> set[str]:
    """Words and word beginnings of a folded text; pairs and triples of characters of unspaced scripts."""
    out = set()
    for w in set(_WORD.findall(folded)):
        if _unspaced(w[0]):
            out.update(w[k : k + size] for size in (2, 3) for k in range(len(w) - size + 1))
        else:
            out.update([w] if len(w) > 2 else [], (f"{w[:k]}*" for k in PREFIXES if len(w) > k))
    return out


def phrases_of(folded: str, starts: set[int]) -> set[str]:
    """Two words with one space between them, one of which begins at one of the starts."""
    words = [m.span() for m in _WORD.finditer(folded)]
    near = (p for p in zip(words, words[1:]) if p[0][0] in starts or p[1][0] in starts)
    return {folded[a:d] for (a, b), (c, d) in near if folded[b:c] == " " and not _unspaced(folded[a]) and not _unspaced(folded[c])}


def _uncovered(found: dict[int, float], spans: list[tuple[int, int]]) -> dict[int, float]:
    """What begins in none of the spans (first, last)."""
    spans = sorted(spans)
    firsts, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
    return {s: w for s, w in found.items() if not (k := bisect_right(firsts, s)) or reach[k - 1] < s}


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, curve: tuple[float, float, float] = (-3.0, 1.0, 1.0)) -> None:
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            a = ahocorasick.Automaton()
            entries: dict[str, list] = {}
            for term, w in self.weights.items():
                entries.setdefault(term.rstrip("*"), []).append((w, term.endswith("*")))
            for phrase in self.exceptions:
                entries.setdefault(fold(phrase), []).append((None, False))
            for key, own in entries.items():
                a.add_word(key, (len(key), own))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, folded: str) -> dict[int, float]:
        """Weight by word start, without what exception phrases cover."""
        found: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        if not self.weights and not self.exceptions:
            return found
        n = len(folded)
        for last, (size, own) in self.automaton().iter(folded):
            start = last - size + 1
            spaced = not _unspaced(folded[start])
            if spaced and start and _joins(folded[start - 1]):
                continue
            open_end = spaced and last + 1 < n and _joins(folded[last + 1])
            for weight, prefix in own:
                if weight is None:
                    if not open_end:
                        excused.append((start, last))
                elif prefix == open_end and weight > found.get(start, 0.0):  # a beginning must go on, a word must end
                    found[start] = weight
        return _uncovered(found, excused) if excused else found

    def measures(self, text: str | None) -> tuple[float, float]:
        """Sum of weights, and its ratio to the length, both dampened."""
        folded = fold(text)
        total = sum(self.hits(folded).values())
        return float(np.log1p(total)), float(np.log1p(100 * total / (20 + len(folded) / 6)))

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-(a + b * x[:, 0] + c * x[:, 1])))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton's method with a small ridge; slopes are kept from turning negative."""
    z = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
    if beta[1] < 0 or beta[2] < 0:
        k = 1 if beta[1] >= beta[2] else 2
        q = np.delete(z, 3 - k, 1)
        b = np.zeros(2)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(q @ b, -30, 30)))
            b = b + np.clip(np.linalg.solve(q.T @ (q * (p * (1 - p))[:, None]) + np.diag([1e-6, 1e-2]), q.T @ (y - p) - np.array([0, 1e-2]) * b), -2, 2)
        beta = np.zeros(3)
        beta[0], beta[k] = b[0], max(0.0, b[1])
    return tuple(float(v) for v in beta)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Lexicon:
    """docs: doc_id, text; labels: doc_id, toxic, training rows only."""
    seeds = {s: SEED_WEIGHT for s in SEEDS}
    some = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    # at most ``rows`` short rows are broadcast; the sample is written, so that the documents are read once
    own = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").repartition(32, "doc_id")
    picked = written(own.select("toxic", "text"), "tox-sample")

    def counted(found_in, name: str) -> DataFrame:  # noqa: ANN001
        """name, toxic, clean: rows of either label in which a string is found."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen = Counter(), Counter()
                for kind, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    seen[kind <= 0].update(found_in(fold(text.as_py())))
                keys = list(seen[0] | seen[1])
                yield pa.record_batch([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)], names=[name, "toxic", "clean"])

        return picked.mapInArrow(run, f"{name} string, toxic long, clean long").groupBy(name).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    # seeds, and terms in enough toxic rows: the most frequent ones, ten times as many as the lexicon takes
    fixed = F.col("term").isin("", *SEEDS)
    often = counted(lambda t: terms_of(t) | {""}, "term").where(fixed | (F.col("toxic") >= MIN_ROWS))
    counts = {r["term"]: (r["toxic"], r["clean"]) for r in often.orderBy(~fixed, F.desc("toxic"), "term").limit(10 * LEXICON + len(SEEDS) + 1).collect()}
    n_toxic, n_clean = counts.pop("", (0, 0))
    if not n_toxic or not n_clean:
        return Lexicon(seeds)
    odds = {t: (n + 0.5) / (n_toxic + 1) / ((c + 0.5) / (n_clean + 1)) for t, (n, c) in counts.items() if n >= MIN_ROWS}
    best = sorted((t for t, o in odds.items() if o >= MIN_ODDS), key=lambda t: (-counts[t][0] * np.log(odds[t]), t))[:LEXICON]
    terms = {t: float(min(6.0, np.log(odds[t]))) for t in best}
    plain = Lexicon(seeds | terms)
    harmless = (F.col("clean") >= MIN_ROWS) & ((F.col("clean") + 0.5) / (n_clean + 1) >= MIN_ODDS * (F.col("toxic") + 0.5) / (n_toxic + 1))
    learnt = counted(lambda t: phrases_of(t, set(plain.hits(t))), "phrase").where(harmless).orderBy(F.desc("clean"), "phrase").limit(LEXICON).collect()
    exceptions = EXCEPTIONS + tuple(r["phrase"] for r in learnt)
    # seeds that other rows hold often, outside exceptions too, are no insults there
    own_seeds = Lexicon(seeds, exceptions)
    used = counted(lambda t: {_WORD.match(t, k)[0] for k in own_seeds.hits(t)}, "seed").where(F.col("clean") > 2 + 0.002 * n_clean).collect()
    lexicon = Lexicon({s: w for s, w in seeds.items() if s not in {r["seed"] for r in used}} | terms, exceptions)

    @F.pandas_udf("a double, b double")
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([lexicon.measures(t) for t in texts], columns=["a", "b"], dtype=float)

    got = picked.select("toxic", measured.asNondeterministic()("text").alias("m")).select("toxic", "m.a", "m.b").toPandas().sort_values(["a", "b", "toxic"])
    lexicon.curve = _logistic(got[["a", "b"]].to_numpy(), (got["toxic"].to_numpy() > 0).astype(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, cut: float = 0.3) -> DataFrame:
    """docs plus score and predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in parts:
            x = np.array([own.measures(t) for t in texts], float).reshape(len(texts), 2)
            yield pd.Series(own.score(x))

    return docs.withColumn("score", scored.asNondeterministic()("text")).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def fold_out(doc_id: Column) -> Column:
    """Held out: crc32 of the id, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
