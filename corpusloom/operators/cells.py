"""Exact nearest vectors that read only the cells they need.

Vectors are kept by cell: the nearest of some centres (k-means over a bounded sample). Each row has
its distance r to the centre, each cell its centre and its least and greatest r. By the triangle
inequality a vector of a cell whose centre is D away from a query is no nearer than the gap between D
and r. A search reads the cells in order of that bound until they hold k rows that pass the filter;
the k-th distance then rules out all cells beyond it, and within the others Parquet skips row groups
by r. Results are those of a full scan; ``last`` tells how many cells and rows were read.

The table of cells is as large as the number of centres, ``CELLS`` at most. Rows without a vector
are left out; vectors have one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import squared_l2

CELLS, SAMPLE, ROUNDS, SEED = 1024, 8192, 8, 3
_SLACK = 1e-5


def _sample(chunks: DataFrame, n: int) -> np.ndarray:
    """About ``SAMPLE`` vectors, the same for the same rows."""
    h = F.xxhash64("sub_id")
    some = chunks.select("embedding", h.alias("h")).where(F.pmod("h", F.lit(1 << 30)) <= int(min(1.0, 1.3 * SAMPLE / n) * (1 << 30)))
    return np.array([r.embedding for r in some.orderBy("h").limit(SAMPLE).collect()], np.float64)


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centres = sample[np.sort(rng.choice(len(sample), cells, replace=False))]
    for _ in range(ROUNDS):
        cell = _distances(sample, centres).argmin(1)
        for k in np.unique(cell):
            centres[k] = sample[cell == k].mean(0)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)[:, None] - 2 * x @ centres.T + np.einsum("ij,ij->i", centres, centres)


class CellTable:
    """Vectors (sub_id, embedding, ..) by cell, below a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()
        self.cells = np.array([r.cell for r in rows], np.int64)
        self.centres = np.array([r.centre for r in rows], np.float64)
        self.least, self.most, self.counts = (np.array([r[c] for r in rows], np.float64) for c in ("least", "most", "n"))
        self.last: dict[str, int] = {}

    @classmethod
    def write(cls, chunks: DataFrame, path: str, cells: int | None = None) -> CellTable:
        spark, chunks = chunks.sparkSession, chunks.where("embedding is not null")
        n = chunks.count()
        if not n:
            chunks.withColumns({"cell": F.lit(0), "r": F.lit(0.0)}).write.parquet(f"{path}/rows")
            spark.createDataFrame([], "cell int, centre array<double>, least double, most double, n long").write.parquet(f"{path}/cells")
            return cls(spark, path)
        sample = _sample(chunks, n)
        centres = _centres(sample, max(1, min(CELLS, cells or int(n**0.5 / 2), len(sample))))

        @F.pandas_udf("struct<cell:int,r:double>")
        def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = np.array(batch.tolist(), np.float64).reshape(len(batch), centres.shape[1])
                cell = _distances(x, centres).argmin(1)
                yield pd.DataFrame({"cell": cell.astype(np.int32), "r": np.sqrt(((x - centres[cell]) ** 2).sum(1))})

        dealt = chunks.withColumn("_p", placed("embedding")).select(*chunks.columns, "_p.cell", "_p.r")
        # by ranges, so that a cell with very many rows takes several files
        dealt.repartitionByRange("cell", "r", "sub_id").sortWithinPartitions("cell", "r").write.partitionBy("cell").parquet(f"{path}/rows")
        per = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.min("r").alias("least"), F.max("r").alias("most"), F.count(F.lit(1)).alias("n"))
        known = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
        known.join(per, "cell").write.parquet(f"{path}/cells")
        return cls(spark, path)

    def _rows(self, cells: np.ndarray, low: float = 0.0, high: float = float("inf")) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/rows").where(F.col("cell").isin([int(c) for c in cells]))
        return rows.where(F.col("r") >= max(low, 0.0)).where(F.col("r") <= high) if np.isfinite(high) else rows

    def nearest(self, q: list[float], k: int, test: Column | None = None) -> DataFrame:
        """The rows with distance (squared, six decimals) of the k nearest, ties by id, of those that pass the test."""
        test = F.lit(True) if test is None else test
        d = F.round(squared_l2(F.col("embedding"), q), 6)
        if not len(self.cells):
            return self.spark.read.parquet(f"{self.path}/rows").withColumn("distance", d).drop("embedding", "cell", "r").limit(0)
        away = np.sqrt(np.maximum(((self.centres - np.array(q)) ** 2).sum(1), 0.0))
        bound = np.maximum(0.0, np.maximum(away - self.most, self.least - away))
        order = np.lexsort((away, bound))
        taken, limit, tried = 0, np.inf, 0
        while taken < len(order):
            # twice as many cells each time, at first as many as hold k rows
            need = k if not taken else 2 * self.counts[order[:taken]].sum()
            taken = min(len(order), int(np.searchsorted(np.cumsum(self.counts[order]), need)) + 1)
            first = self._rows(self.cells[order[:taken]]).where(test).select(d.alias("distance")).orderBy("distance").limit(k)
            found = first.agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("last")).first()
            tried += 1
            if found.n >= k:
                limit = float(np.sqrt(found.last + 1e-6)) + _SLACK
                break
        near = order[bound[order] <= limit]
        low, high = (float((away[near] - limit).min()), float((away[near] + limit).max())) if np.isfinite(limit) else (0.0, float("inf"))
        self.last = {"cells": len(self.cells), "read": len(near), "rows": int(self.counts[near].sum()), "of": int(self.counts.sum()), "tries": tried}
        rows = self._rows(self.cells[near], low, high).where(test).withColumn("distance", d)
        return rows.drop("embedding", "cell", "r").orderBy("distance", "sub_id").limit(k)
