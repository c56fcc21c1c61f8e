"""Whitening of embeddings by a randomised range finder with power passes and Rayleigh-Ritz.

A vector's entries become whole numbers, x = floor(scale * entry). The fit list has each distinct x
once: n of them, with exact sums S per dimension. Its covariance V (divisor n) is never taken from
raw moments: every pass over the list centres each row by S / n and adds up what the row gives.

* The range finder starts from ``k + OVERSAMPLE`` random directions Q. A pass gives V Q, hence by
  Rayleigh-Ritz the k leading components in the span of Q and their residuals |V u - e u|.
* Residuals above ``TOLERANCE`` of the largest eigenvalue call for a further pass from an orthonormal
  basis of V Q. After ``PASSES`` of them the basis is expanded to the full dimension, where V Q is V
  itself and the components are its eigenvectors to double precision.
* One more pass measures how far the covariance of the whitened list is from the identity.

A pass leaves one block of a dimension's square at most per task; blocks are added in ``MERGERS``
tasks and the driver gets one from each. Only the mean and k components go back to the tasks. So
memory follows the dimension and never the number of rows.

Vectors that are null or empty, or hold null or non-finite entries, are left out. Vectors have one
dimension: the most frequent one (the larger one of a tie), and rows of another are left out too.
Repeated rows and ties weigh once in the fit and are all whitened. Components without variance
(equal vectors, fewer rows than components) can't be whitened and aren't given, so an empty table,
or one of equal vectors, has none; its rows then have an empty ``whitened``. Entries beyond the range
of a long are cut to it, and a ``deviation`` beyond that range is null. Other columns are carried
along, but that ``whitened`` and ``deviation`` replace input columns of these names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches, written

COMPONENTS, SCALE = 4, 256
OVERSAMPLE, PASSES, TOLERANCE, SEED = 8, 6, 1e-13, 12
MERGERS = 8
RESULTS = ("whitened", "deviation")


@dataclass
class Whitening:
    """What the fit gives: components are the rows of a matrix, by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0
    #: Directions of the basis that the components were taken from.
    basis: int = 0
    residuals: list[float] = field(default_factory=list)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


def whole(vector: Column, scale: int = SCALE) -> Column:
    """The entries as whole numbers; null for vectors that can't be used."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale))
    return F.when((F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True)), x)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum of ``part`` over blocks of the rows (x)."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0)))
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["block"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for block in batch.column(0):
                total += np.frombuffer(block.as_buffer()).reshape(shape)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["block"])

    blocks = rows.mapInArrow(own, "block binary").repartition(MERGERS).mapInArrow(merged, "block binary")
    return sum((np.frombuffer(r.block).reshape(shape) for r in blocks.collect()), np.zeros(shape))


def _exact_sums(rows: DataFrame) -> list[int]:
    """Sums per dimension without rounding or overflow."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                small = float(np.abs(x.astype(np.float64)).max()) * len(x) < 2.0**62
                found = (x if small else x.astype(object)).sum(0).tolist()
                total = [a + b for a, b in zip(total, found)] if total else found
        yield pa.record_batch([pa.array([[str(s) for s in total]], pa.list_(pa.string()))], names=["sums"])

    each = rows.mapInArrow(own, "sums array<string>").select(F.posexplode("sums").alias("at", "s"))
    return [int(r.s) for r in each.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()]


def fit(embeddings: DataFrame, k: int = COMPONENTS, vector: str = "embedding", scale: int = SCALE) -> Whitening:
    """The k leading components of the distinct vectors."""
    small_batches(embeddings.sparkSession)
    x = embeddings.select(whole(F.col(vector), scale).alias("x")).where("x is not null")
    sizes = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return Whitening(0, [], np.empty((0, 0)), np.empty(0), 0.0)
    d = sizes.d
    rows = written(x.where(F.size("x") == d).distinct(), "white-fit")
    model = Whitening(rows.count(), _exact_sums(rows), np.empty((0, d)), np.empty(0), 0.0)
    mean, n = model.mean, model.n

    def image(q: np.ndarray) -> np.ndarray:
        """V q, and the trace of V below it."""

        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return np.vstack([centred.T @ (centred @ q), np.full((1, q.shape[1]), np.einsum("ij,ij->", centred, centred))])

        return _added(rows, part, (d + 1, q.shape[1])) / n

    rng = np.random.default_rng(SEED)
    width = min(d, k + OVERSAMPLE)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0] if width < d else np.eye(d)
    for turn in range(PASSES + 2):
        y = image(q)
        y, model.trace = y[:-1], float(y[-1, 0])
        ritz = q.T @ y
        e, w = np.linalg.eigh((ritz + ritz.T) / 2)
        e, w = e[::-1][:k], w[:, ::-1][:, :k]
        u = q @ w
        gap = np.linalg.norm(y @ w - u * e, axis=0)
        model.residuals.append(float(gap.max() / e[0]) if e[0] > 0 else 0.0)
        model.basis = q.shape[1]
        if q.shape[1] == d or model.residuals[-1] <= TOLERANCE:
            break
        q = np.linalg.qr(y)[0] if turn < PASSES else np.eye(d)
    real = e > d * np.finfo(float).eps * model.trace
    model.components, model.eigenvalues = u.T[real], e[real]
    if len(model.eigenvalues):
        model.identity_error = _identity_error(rows, model)
    return model


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list, less the identity."""
    k, project = len(model.eigenvalues), _projection(model)

    def part(x: np.ndarray) -> np.ndarray:
        w = project(x)
        return np.vstack([w.T @ w, w.sum(0)])

    moments = _added(rows, part, (k + 1, k)) / model.n
    return float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(k)).max())


def _projection(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    mean, onto = model.mean, (model.components / np.sqrt(model.eigenvalues)[:, None]).T
    return lambda x: (x - mean) @ onto


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) squared, exactly."""
    most = n * float(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * max(1, x.shape[1]) < 2.0**62:
        y = n * x - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", y, y).tolist()
    y = n * x.astype(object) - np.array(sums, object)
    return [int(s) if s < 1 << 63 else None for s in (y * y).sum(1)]


def whiten(embeddings: DataFrame, model: Whitening, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The rows that can be used, with ``whitened`` (one value a component) and ``deviation``."""
    small_batches(embeddings.sparkSession)
    own = [c for c in embeddings.columns if c.lower() not in RESULTS]
    row, entries = fresh(embeddings, "row", "x")
    packed = embeddings.select(F.struct(*[F.col(f"`{c}`") for c in own], F.lit(True)).alias(row), whole(F.col(f"`{vector}`"), scale).alias(entries))
    usable = packed.where(F.size(entries) == len(model.sums)).where(F.col(entries).isNotNull())
    k, n, sums, project = len(model.eigenvalues), model.n, model.sums, _projection(model) if len(model.eigenvalues) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                flat = pa.array((project(x) if project else np.empty((len(x), 0))).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), flat)
                yield pa.record_batch([batch.column(0), lists, pa.array(deviations(x, n, sums), pa.int64())], names=[row, *RESULTS])

    found = usable.mapInArrow(run, f"{row} {packed.schema[row].dataType.simpleString()}, whitened array<double>, deviation bigint")
    return found.select(*[F.col(row).getField(c).alias(c) for c in own], *RESULTS)
