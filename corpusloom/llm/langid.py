"""Language identification by nearest centroids of TF-IDF character n-grams.

Letters are lower-cased, everything else becomes a space; n-grams of 1 to 4 bytes are hashed into
``BUCKETS`` features. Document frequencies come from all training documents. Centroids (several per
language, by spherical k-means) are fitted on a bounded sample of training rows per language:
``FIT_ROWS`` in hash order, a documented parameter. A text gets the language of the most similar
centroid by cosine. ``rejected`` says that the distance is above what training rows of that
language show (the ``QUANTILE`` of theirs plus a margin); the nearest language is reported still.

Null texts and texts without a letter are ``und`` with score 0; texts without any trained language
are ``und`` too. Ties go to the language that sorts first. Repeated rows get equal results, other
columns are carried along, and an input column named like a result column is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

BUCKETS = 1 << 12
FIT_ROWS = 400
CENTROIDS = 4
QUANTILE, MARGIN = 0.995, 0.05
_SPACE = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
_PIECE = 1 << 20


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None without a letter."""
    if not text or not any(c.isalpha() for c in text[:200]) and not any(map(str.isalpha, text)):
        return None
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SPACE).split()) + b" "
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw), _PIECE):
        x = np.frombuffer(raw[at : at + _PIECE + 3], np.uint8).astype(np.uint32)
        code = x.copy()
        for n in range(1, 5):
            if n > 1:
                code = (code[:-1] << np.uint32(8)) | x[n - 1 :]
            total += np.bincount((code[:_PIECE] * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20), minlength=BUCKETS)[:BUCKETS]
    return total


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Of every bucket over all training documents: one row of partial sums per task, summed in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if (c := ngram_counts(text.as_py())) is not None:
                    seen += c > 0
                    n += 1
        k = np.append(np.arange(BUCKETS), -1)
        yield pa.record_batch([pa.array(k), pa.array(np.append(seen, n))], names=["bucket", "n"])

    got = train.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS, np.int64)
    own = got["bucket"].to_numpy() >= 0
    df[got["bucket"].to_numpy()[own]] = got["n"].to_numpy()[own]
    return df, int(got["n"].to_numpy()[~own].sum())


def _sample(train: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` documents of each language; no language is gathered whole in one task."""
    keys = train.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    part = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "doc_id")
    few = keys.withColumn("r", F.row_number().over(part)).where(F.col("r") <= max(1, rows // 16)).drop("r")
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= rows)
    return few.select("doc_id", "lang")


def _kmeans(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: min(k, len(x))]]
    for _ in range(12):
        nearest = (x @ centres.T).argmax(1)
        centres = _unit(np.stack([x[nearest == j].sum(0) if (nearest == j).any() else centres[j] for j in range(len(centres))]))
    return centres


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, owner: np.ndarray, reach: np.ndarray) -> None:
        self.idf, self.langs, self.centres, self.owner, self.reach = idf, langs, centres, owner, reach

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        found = [ngram_counts(t) for t in texts]
        rows = [k for k, c in enumerate(found) if c is not None]
        lang, score, far = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if rows and len(self.langs):
            sims = _tfidf(np.stack([found[k] for k in rows]), self.idf) @ self.centres.T
            best = sims.argmax(1)
            for k, b, s in zip(rows, best, sims[np.arange(len(rows)), best]):
                lang[k], score[k], far[k] = self.langs[self.owner[b]], min(1.0, max(0.0, s)), s < self.reach[self.owner[b]]
        return lang, score, far


def fit(train: DataFrame, rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> Model:
    """train: doc_id, text, lang (rows without a lang are left out)."""
    train = train.where("lang is not null").select("doc_id", "text", "lang")
    df, n = document_frequencies(train)
    idf = np.log((n + 1) / (df + 1)) + 0.05
    # FIT_ROWS ids per language, so small for any number of documents
    some = F.broadcast(_sample(train, rows))

    @F.pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([None if (c := ngram_counts(t)) is None else zlib.compress(c.astype(np.uint32).tobytes(), 1) for t in texts])

    got = train.join(some, ["doc_id", "lang"]).select("doc_id", "lang", vector("text").alias("v")).toPandas().dropna()
    got = got.sort_values(["lang", "doc_id", "v"])
    langs = sorted(got["lang"].unique())
    centres, owner, reach = [], [], []
    for k, lang in enumerate(langs):
        x = _tfidf(np.stack([np.frombuffer(zlib.decompress(v), np.uint32) for v in got.loc[got["lang"] == lang, "v"]]).astype(np.float64), idf)
        c = _kmeans(x, centroids)
        centres.append(c)
        owner += [k] * len(c)
        reach.append(float(np.quantile((x @ c.T).max(1), 1 - QUANTILE)) - MARGIN)
    return Model(idf, langs, np.concatenate(centres) if centres else np.zeros((0, BUCKETS)), np.array(owner, int), np.array(reach))


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """docs plus lang_pred, score, rejected."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(train))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score, far = model.value.predict(list(texts))
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": far})

    found = docs.withColumn("_found", predict.asNondeterministic()("text"))
    return found.withColumns({c: F.col(f"_found.{c}") for c in ("lang_pred", "score", "rejected")}).drop("_found")


def fold(doc_id: Column) -> Column:
    """Held out: crc32 of the id, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
