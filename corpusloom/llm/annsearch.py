"""Approximate nearest neighbours by cosine over randomly rotated one-bit codes.

Index. Vectors are scaled to length 1. Cells (k-means over a bounded sample of at most
``SAMPLE_BYTES`` and ``SAMPLE`` rows, a function of ids and vectors) give each a nearest centre c;
what is left, r = u - c, is rotated at random into ``bits`` dimensions and kept as its signs, one bit
each. With b the signs over the root of their number, and a = <b, r / |r|>, the inner product with a
query is estimated as <u, q> ~ <c, q> + |r| <b, q> / a, and but for a probability of some 0.1 % it exceeds that
by no more than |r| * ERRORS * sqrt((1 - a * a) / (bits - 1)) / a. Every row is indexed: its codes, the two
scalars and its vector, sorted by cell; a large cell is cut into several partitions.

Search. Queries are dealt by hash to groups of a fixed number of bytes; groups are taken one after
the other, and a group is broadcast to one pass over the index. A task holds the k best per query so
far and starts from the k-th best cosine within the sample. Rows of a cell are skipped if <c, q> and
the largest |r| can't reach it, as are rows whose estimate and bound don't; the others are
reranked by the cosine of the original vectors. A task gives k rows a query at most, and these alone
are shuffled. Estimates for a query set that grows with the rows grow with their product; no pair
leaves its task.

Left out are vectors that are null, empty or zero, or hold null or non-finite entries, rows without an
id, and vectors of another dimension than the most frequent one (the larger one of a tie). Repeated rows are
candidates each; a query's own id never is. A query id that occurs several times is searched once, by
its smallest vector. Ties go to the smaller id. With fewer than k candidates all are given; an empty
table has no results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, trim, written

LEAST_BITS, ERRORS, SEED = 256, 3.0, 13
SAMPLE, SAMPLE_BYTES, CELLS, ROWS_A_CELL, ROUNDS = 8192, 32 << 20, 128, 64, 10
GROUP_BYTES = 32 << 20
#: Index rows and queries that meet in one product.
CHUNK, BLOCK, PAIRS = 2048, 1024, 1 << 14
#: Estimates are in single precision.
_ROUNDING = 1e-5
RESULT = "query_id bigint, vec_id bigint, score double"


@dataclass
class Model:
    dimension: int
    rotation: np.ndarray  # bits x dimension
    centres: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray  # original vectors


@dataclass
class Index:
    model: Model
    rows: DataFrame


def usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True)) & F.exists(vector, lambda c: c != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _even(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square overflows or vanishes; cosines stay the same to the bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each pair of rows."""
    x, y = _even(x), _even(y)
    return np.einsum("ij,ij->i", x, y) / (_norms(x) * _norms(y))


def _units(x: np.ndarray) -> np.ndarray:
    x = _even(x)
    return x / _norms(x)[:, None]


def _centres(units: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Means of k-means cells over the sample; empty cells stay where they began."""
    n = max(1, min(CELLS, len(units) // ROWS_A_CELL))
    centres = units[np.sort(rng.choice(len(units), n, replace=False))]
    for _ in range(ROUNDS):
        cell = _nearest(units, centres)
        size = np.bincount(cell, minlength=n)
        total = np.zeros_like(centres)
        np.add.at(total, cell, units)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def _nearest(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin(np.einsum("ij,ij->i", centres, centres) - 2 * units @ centres.T, axis=1)


def fit(vectors: DataFrame) -> Model | None:
    """From usable rows (vec_id, vector)."""
    sizes = vectors.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return None
    d = sizes.d
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
    # a hash bound first, so that no task sorts much more than the sample
    h = F.xxhash64("vec_id", "vector")
    share = min(1.0, 1.3 * most / sizes.n + 1e-9)
    drawn = vectors.where(F.size("vector") == d).withColumn("h", h).where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))
    found = drawn.orderBy("h", "vec_id").limit(most).select("vec_id", "vector").toArrow().combine_chunks()
    rng = np.random.default_rng(SEED)
    bits = max(LEAST_BITS, -(-d // 64) * 64)
    rotation = np.linalg.qr(rng.standard_normal((bits, d)))[0]
    sample = _matrix(found.column(1).chunk(0)) if found.num_rows else np.empty((0, d))
    centres = _centres(_units(sample), rng) if len(sample) else np.zeros((1, d))
    return Model(d, rotation, centres, found.column(0).to_numpy(), sample)


def encode(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cell, packed signs, correction scalar, error bound and |r| of each vector."""
    units = _units(x)
    cell = _nearest(units, model.centres)
    rest = units - model.centres[cell]
    length, bits = _norms(rest), len(model.rotation)
    turned = rest @ model.rotation.T
    # a is at least 1 / sqrt(bits), as a sum of absolute values is no less than the length
    a = np.abs(turned).sum(1) / np.sqrt(bits) / np.maximum(length, 1e-300)
    a = np.where(length > 0, np.clip(a, 1e-9, 1), 1)
    scale = length / (np.sqrt(bits) * a)
    bound = length * ERRORS * np.sqrt((1 - a * a) / (bits - 1)) / a
    return cell, np.packbits(turned > 0, axis=1), scale, bound, length


def build(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> Index | None:
    """The index of all usable rows, written; None if there are none."""
    small_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    model = fit(rows)
    if model is None:
        return None
    held = embeddings.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, code, scale, bound, length = encode(_matrix(batch.column(1)), held.value)
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(code.shape[1]), len(code), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
                yield pa.record_batch(
                    [batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), codes, pa.array(scale), pa.array(bound), pa.array(length)],
                    names=["vec_id", "vector", "cell", "code", "scale", "bound", "length"],
                )

    kind = rows.schema["vector"].dataType.simpleString()
    schema = f"vec_id bigint, vector {kind}, cell int, code binary, scale double, bound double, length double"
    coded = rows.where(F.size("vector") == model.dimension).mapInArrow(run, schema)
    return Index(model, written(coded.repartitionByRange("cell", "length", "vec_id").sortWithinPartitions("cell", "length"), "ann-index"))


class _Group:
    """The queries of a group: ids, vectors, rotated unit vectors, and what each must reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, model: Model, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        units = _units(vectors)
        self.turned = (units @ model.rotation.T).astype(np.float32)
        self.to_centres = units @ model.centres.T
        self.floor = np.full(len(ids), -np.inf)
        if len(model.sample) >= k:
            sample = _units(model.sample)
            for at in range(0, len(ids), BLOCK):
                near = units[at : at + BLOCK] @ sample.T
                near[ids[at : at + BLOCK, None] == model.sample_ids[None, :]] = -np.inf
                self.floor[at : at + BLOCK] = np.partition(near, -k, axis=1)[:, -k] - 1e-9


class _Best:
    """The k best rows of each query so far."""

    def __init__(self, group: _Group) -> None:
        self.group, self.k = group, group.k
        self.floor = group.floor.copy()
        self.query, self.score, self.ids = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        held = np.isin(self.query, query)
        q, s, i = (np.concatenate(x) for x in ((self.query[held], query), (self.score[held], score), (self.ids[held], ids)))
        by = np.lexsort((i, -s, q))
        q, s, i = q[by], s[by], i[by]
        head = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
        top = place < self.k
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        self.query, self.score, self.ids = (np.concatenate(x) for x in ((self.query[~held], q[top]), (self.score[~held], s[top]), (self.ids[~held], i[top])))

    def search(self, vec_id: np.ndarray, vectors: np.ndarray, cell: int, code: np.ndarray, scale: np.ndarray, bound: np.ndarray, length: np.ndarray) -> None:
        """Rows of one cell."""
        g = self.group
        able = np.flatnonzero(g.to_centres[:, cell] + length.max() + _ROUNDING >= self.floor)
        if not len(able):
            return
        signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
        for at in range(0, len(able), BLOCK):
            own = able[at : at + BLOCK]
            reach = g.turned[own] @ signs.T
            reach *= scale.astype(np.float32)
            reach += (bound + _ROUNDING).astype(np.float32)
            q, row = np.nonzero(reach >= (self.floor[own] - g.to_centres[own, cell]).astype(np.float32)[:, None])
            q = own[q]
            other = g.ids[q] != vec_id[row]
            q, row = q[other], row[other]
            for p in range(0, len(q), PAIRS):
                a, b = q[p : p + PAIRS], row[p : p + PAIRS]
                score = cosines(g.vectors[a], vectors[b])
                keep = score >= self.floor[a]
                if keep.any():
                    self.add(a[keep], score[keep], vec_id[b[keep]])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CHUNK:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def search(index: Index | None, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of each query (query_id, vector), nearest first."""
    spark = queries.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    model = index.model
    size = max(1, GROUP_BYTES // (4 * len(model.rotation) + 8 * (model.dimension + len(model.centres))))
    asked = queries.where(usable(F.col("vector")) & F.col("query_id").isNotNull()).where(F.size("vector") == model.dimension)
    asked = written(asked.groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.min("vector").alias("vector")), "ann-queries")
    groups = max(1, -(-asked.count() // size))
    found = None
    for number in range(groups):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == number).orderBy("query_id").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        held = spark.sparkContext.broadcast(_Group(own.column(0).to_numpy(), _matrix(own.column(1).chunk(0)), model, k))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            best = _Best(held.value)
            for batch in _chunks(batches):
                ids, vectors, cells = batch.column("vec_id").to_numpy(), _matrix(batch.column("vector")), batch.column("cell").to_numpy()
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                scalars = [batch.column(c).to_numpy() for c in ("scale", "bound", "length")]
                edges = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
                for a, b in zip(edges, np.append(edges[1:], len(ids))):
                    best.search(ids[a:b], vectors[a:b], cells[a], code[a:b], *[x[a:b] for x in scalars])
            yield pa.record_batch([pa.array(held.value.ids[best.query]), pa.array(best.ids), pa.array(best.score)], names=["query_id", "vec_id", "score"])
            trim()

        # written, so that the group's broadcast can go before the next one is made
        part = written(index.rows.mapInArrow(scan, RESULT), "ann-found")
        held.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of each row whose id is divisible by ``every``."""
    asked = embeddings.where(F.col(vec_id) % every == 0).select(F.col(vec_id).alias("query_id"), F.col(vector).alias("vector"))
    return search(build(embeddings, vec_id, vector), asked, k)
