"""Cross-entropy difference of a target and a background language model.

Tokens are characters (lower-cased). Both n-gram models share one vocabulary, counted over the whole
corpus: every character it has, up to ``SYMBOLS``, beyond which the rarest share one symbol.
A document is never scored by a model that has seen its text: texts fall into two folds by hash, and
each fold is scored by the models counted on the other one. In each fold the models are matched: the
background model is counted on documents outside the target, taken in the order of a hash of id and text
until they have as many tokens as the target (and the other way round if there are fewer others). The
document that reaches the number is the last one taken, so a sample is never empty and exceeds the
number by less than one document (rows of equal id and text are taken together).

Counts are exact and grow with the corpus: a Spark table of all n-grams of ``ORDER`` characters, from
which the lower orders and the contexts are summed. Each order's probability is smoothed with the next
lower one: (count + A * lower) / (context count + A), the lowest one being uniform. A token's loss
depends on its n-gram only, so every n-gram's losses are worked out once, by joins, and a document's
loss is a sum over its n-grams: of a broadcast table as long as that has at most ``FEW_GRAMS`` rows, of
a shuffled join with it beyond. The target's ids are broadcast up to ``FEW_IDS``, shuffled beyond.

Per document: score (mean per-token difference, target minus background; lower is more like the
target), target_loss and background_loss (mean nats per token), n_tokens.

Null and empty texts have no tokens and zeros. Without a target set, or without other documents, the
missing model is uniform. Repeated rows count as often as they occur and score alike. Null ids are
never in the target. Other columns are carried along whatever their names; an input column named like
a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches, trim, written

ORDER, A = 4, 6.0
SYMBOLS = 65_533
FEW_GRAMS, FEW_IDS = 2_000_000, 1_000_000
STEP = 16
_OTHER, _BITS, _PIECE = SYMBOLS + 1, 16, 1 << 20
KINDS = ("target", "background")
RESULTS = ("score", "target_loss", "background_loss", "n_tokens")


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def vocabulary(docs: DataFrame) -> np.ndarray:
    """The code points of the corpus, the most frequent SYMBOLS of them, in their own order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x110000, np.int64)
        for batch in batches:
            for text in batch.column(0):
                x = _points(text.as_py())
                for at in range(0, len(x), _PIECE):
                    c = np.bincount(x[at : at + _PIECE])
                    seen[: len(c)] += c
        k = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(k), pa.array(seen[k])], names=["point", "n"])

    got = docs.select("text").mapInArrow(count, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point").limit(SYMBOLS)
    return np.sort(got.toPandas()["point"].to_numpy(dtype=np.uint32))


def symbol_table(points: np.ndarray) -> np.ndarray:
    """Symbols by code point; 0 stands before a text's beginning."""
    table = np.full(0x110000, _OTHER, np.uint16)
    table[points] = np.arange(1, len(points) + 1, dtype=np.uint16)
    return table


def grams(text: str | None, table: np.ndarray) -> Iterator[np.ndarray]:
    """The n-gram that ends at each token, its symbols packed with the last one lowest, piece by piece."""
    x = np.concatenate([np.zeros(ORDER - 1, np.uint16), table[_points(text)]])
    for at in range(ORDER - 1, len(x), _PIECE):
        stop = min(at + _PIECE, len(x))
        out = np.zeros(stop - at, np.uint64)
        for k in range(ORDER):
            out |= x[at - k : stop - k].astype(np.uint64) << np.uint64(_BITS * k)
        yield out.view(np.int64)


def _hash(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(seed)), F.lit(1 << 20))


def _fold() -> Column:
    return (_hash(2) % 2).cast("int")


def sampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, text, fold (0, 1), part: 1 target, 2 background, 0 neither."""
    ids = target.where("doc_id is not null").select(F.col("doc_id").alias("tid")).distinct()
    ids = ids.withColumn("own", F.lit(True))
    ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids.hint("merge")
    flagged = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("tid"), "left").select("doc_id", "text", F.coalesce("own", F.lit(False)).alias("own"))
    flagged = flagged.withColumn("fold", _fold()).withColumn("h", F.xxhash64(F.lit(1), F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))))
    sizes = written(flagged.groupBy("fold", "own", "h").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n")).where("n > 0"), "lm-sizes")
    last = {k: _last_taken(sizes.where((F.col("fold") == k[0]) & (F.col("own") == k[1])), most) for k, most in _wanted(sizes).items()}
    taken = F.lit(True)
    for (fold, own), h in last.items():
        taken = F.when((F.col("fold") == fold) & (F.col("own") == own), F.col("h") <= h).otherwise(taken)
    part = F.when(taken, F.when(F.col("own"), 1).otherwise(2)).otherwise(0)
    return flagged.select("doc_id", "text", "fold", part.alias("part"))


def _wanted(sizes: DataFrame) -> dict[tuple[int, bool], int]:
    """The larger side of a fold, and the tokens it is cut to."""
    total = {(r.fold, r.own): r.n for r in sizes.groupBy("fold", "own").agg(F.sum("n").alias("n")).collect()}
    found = {}
    for fold in (0, 1):
        ours, others = total.get((fold, True), 0), total.get((fold, False), 0)
        if ours and others and ours != others:
            found[fold, ours > others] = min(ours, others)
    return found


def _last_taken(sizes: DataFrame, most: int) -> int:
    """The least h whose rows, and those below it, have ``most`` tokens: found by its bits from the top, ``STEP`` of them a pass."""
    rows = sizes.withColumn("u", F.col("h").bitwiseXOR(F.lit(-(1 << 63))))  # unsigned order
    prefix, bits = 0, 0
    while bits < 64:
        bits += STEP
        held = rows.where(F.shiftrightunsigned("u", 64 - bits + STEP) == prefix) if prefix or bits > STEP else rows
        counted = held.groupBy(F.shiftrightunsigned("u", 64 - bits).alias("k")).agg(F.sum("n").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        for r in sorted(counted.collect()):  # at most 2 ** STEP rows
            if r.n >= most:
                break
            most -= r.n
        if r.low == r.high:
            return r.low
        prefix = r.k
    return r.low


def gram_counts(flagged: DataFrame, points: np.ndarray) -> DataFrame:
    """gram, and by kind and fold that it is counted for (the other one than the text's): t0, b0, t1, b1. Every n-gram of the corpus has a row."""
    shared = flagged.sparkSession.sparkContext.broadcast(points)
    names = ("t0", "b0", "t1", "b1")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table(shared.value)
        held: list[np.ndarray] = []
        kinds: list[np.ndarray] = []
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal held, kinds, size
            all_grams, kind = np.concatenate(held), np.concatenate(kinds)
            key, place = np.unique(all_grams, return_inverse=True)
            out = [np.bincount(place[kind == k], minlength=len(key)) for k in range(4)]
            held, kinds, size = [], [], 0
            for at in range(0, len(key), 1 << 16):
                yield pa.record_batch([pa.array(c[at : at + (1 << 16)].astype(np.int64)) for c in (key, *out)], names=["gram", *names])

        for batch in batches:
            for text, fold, part in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for piece in grams(text.as_py(), table):
                    held.append(piece)
                    kinds.append(np.full(len(piece), 4 if not part else 2 * (1 - fold) + part - 1, np.int8))
                    size += len(piece)
            if size > 1 << 21:
                yield from counted()
        if held:
            yield from counted()
        trim()

    rows = flagged.select("text", "fold", "part").mapInArrow(count, "gram long, t0 long, b0 long, t1 long, b1 long")
    return rows.groupBy("gram").agg(*[F.sum(c).alias(c) for c in names])


def gram_losses(counts: DataFrame, symbols: int) -> DataFrame:
    """gram, t0, b0, t1, b1: the loss of its last character under each model."""
    names = ("t0", "b0", "t1", "b1")
    mask = lambda n: F.col("gram").bitwiseAND(F.lit((1 << _BITS * n) - 1)) if n < ORDER else F.col("gram")
    totals = counts.agg(*[F.sum(c).alias(f"{c}_all") for c in names]).first()
    p = {c: F.lit(1.0 / (symbols + 1)) for c in names}
    rows = counts
    for n in range(1, ORDER + 1):
        own = {c: F.col(c) for c in names}
        if n < ORDER:
            sums = counts.groupBy(mask(n).alias(f"k{n}")).agg(*[F.sum(c).alias(f"{c}_{n}") for c in names])
            rows = rows.withColumn(f"k{n}", mask(n)).join(sums, f"k{n}").drop(f"k{n}")
            own = {c: F.col(f"{c}_{n}") for c in names}
        if n == 1:
            context = {c: F.lit(totals[f"{c}_all"] or 0) for c in names}
        else:
            before = F.shiftrightunsigned(mask(n), _BITS)
            sums = counts.groupBy(before.alias(f"x{n}")).agg(*[F.sum(c).alias(f"{c}_x{n}") for c in names])
            rows = rows.withColumn(f"x{n}", before).join(sums, f"x{n}").drop(f"x{n}")
            context = {c: F.col(f"{c}_x{n}") for c in names}
        p = {c: (own[c] + A * p[c]) / (context[c] + A) for c in names}
    return rows.select("gram", *[(-F.log(p[c])).alias(c) for c in names])


def fit(docs: DataFrame, target: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """The vocabulary, and the losses of every n-gram of the corpus (written)."""
    small_batches(docs.sparkSession)
    points = vocabulary(docs)
    counts = written(gram_counts(sampled(docs, target), points), "lm-counts")
    return points, written(gram_losses(counts, len(points) + 1), "lm-losses")


def _sums_broadcast(docs: DataFrame, points: np.ndarray, losses: DataFrame, fold: str, into: str) -> DataFrame:
    """docs with a struct of summed losses, looked up in a table that every task holds."""
    got = losses.orderBy("gram").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((points, *[got.column(k).to_numpy() for k in range(5)]))

    @F.pandas_udf("t double, b double, n long")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own, keys, *tables = shared.value
        symbols = symbol_table(own)
        for texts, folds in parts:
            rows = []
            for text, k in zip(texts, folds):
                t = b = 0.0
                n = 0
                for piece in grams(text, symbols):
                    at = np.searchsorted(keys, piece)
                    t, b, n = t + float(tables[2 * k][at].sum()), b + float(tables[2 * k + 1][at].sum()), n + len(piece)
                rows.append((t, b, n))
            yield pd.DataFrame(rows, columns=["t", "b", "n"]).astype({"t": float, "b": float, "n": "int64"})
        trim()

    return docs.withColumn(into, scored.asNondeterministic()("text", fold))


def _sums_joined(docs: DataFrame, points: np.ndarray, losses: DataFrame, fold: str, into: str) -> DataFrame:
    """The same by a join of each distinct text's n-grams with the table."""
    shared = docs.sparkSession.sparkContext.broadcast(points)
    h, key = fresh(docs, "h", "key")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = symbol_table(shared.value)
        for batch in batches:
            for row, text, k in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                for piece in grams(text.as_py(), symbols):
                    gram, n = np.unique(piece, return_counts=True)
                    yield pa.record_batch([pa.array([row] * len(gram), pa.string()), pa.array([k] * len(gram), pa.int32()), pa.array(gram), pa.array(n.astype(np.int64))], names=["key", "fold", "gram", "n"])

    named = docs.withColumn(h, F.md5(F.coalesce("text", F.lit(""))))
    each = named.select(F.col(h).alias("key"), "text", F.col(fold).alias("fold")).dropDuplicates(["key"])
    rows = each.mapInArrow(spread, "key string, fold int, gram long, n long").join(losses, "gram")
    summed = lambda a, b: F.sum(F.col("n") * F.when(F.col("fold") == 0, F.col(a)).otherwise(F.col(b)))
    per = rows.groupBy(F.col("key").alias(key)).agg(F.struct(summed("t0", "t1").alias("t"), summed("b0", "b1").alias("b"), F.sum("n").alias("n")).alias(into))
    return named.join(per, F.col(h) == F.col(key), "left").drop(h, key)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, few_grams: int = FEW_GRAMS) -> DataFrame:
    """docs plus score, target_loss, background_loss, n_tokens; target: the doc_ids of the target set."""
    points, losses = fit(docs, target)
    fold, sums = fresh(docs, "lm_fold", "lm_sums")
    by = _sums_broadcast if losses.count() <= few_grams else _sums_joined
    found = by(docs.withColumn(fold, _fold()), points, losses, fold, sums)
    value = lambda c: F.coalesce(F.try_divide(F.col(f"{sums}.{c}"), F.col(f"{sums}.n")), F.lit(0.0))
    columns = {"score": value("t") - value("b"), "target_loss": value("t"), "background_loss": value("b"), "n_tokens": F.coalesce(F.col(f"{sums}.n"), F.lit(0)).cast("long")}
    return found.withColumns(columns).drop(fold, sums)
