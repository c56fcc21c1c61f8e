"""Exact vector retrieval, roll-up to passages, ranking and fusion.

One plan: a scan of ids and vectors, TakeOrderedAndProject for the top k, and joins of at most k
rows afterwards; texts are read only for what remains. Distances are Euclidean squares, smaller is
better; similarity is the negated distance. ``farthest_first`` sorts the other way round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import deep_link, file_type, rerank_context
from ..functions.urls import under_prefix

TOP, TOP_FILTERED, RESULTS = 50, 1000, 15
BLOCK, GROUP_BYTES = 256, 64 << 20


def squared_l2(v: Column, q: list[float]) -> Column:
    query = F.array(*[F.lit(float(x)) for x in q])
    parts = F.zip_with(v, query, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def squared_l2_batch(q: list[float]) -> Callable[[Column], Column]:
    """The same over Arrow batches in numpy, for long vectors."""
    query = np.asarray(q, np.float64)

    @F.pandas_udf("double")
    def distance(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=float)
        d = np.stack(vectors.to_numpy()).astype(np.float64) - query
        return pd.Series(np.einsum("ij,ij->i", d, d))

    return distance


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))), F.lit(0.0))


def query_vector(embeddings: DataFrame, vec_id: int) -> list[float]:
    """One row's vector."""
    row = embeddings.where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else []


def nearest(chunks: DataFrame, q: list[float], k: int = TOP, batch: bool = False, farthest_first: bool = False) -> DataFrame:
    """chunks (sub_id, embedding, ..) plus distance: the k nearest, ties by id."""
    d = F.round(squared_l2_batch(q)(F.col("embedding")) if batch else squared_l2(F.col("embedding"), q), 6)
    order = F.desc("distance") if farthest_first else F.asc("distance")
    return chunks.withColumn("distance", d).drop("embedding").orderBy(order, "sub_id").limit(k)


def nearest_with_prefix(chunks: DataFrame, q: list[float], prefix: str | None, k: int = TOP_FILTERED, before: bool = False) -> DataFrame:
    """With a URL prefix: tested on the k nearest, or before the limit if ``before``."""
    if before:
        return nearest(chunks.where(under_prefix(F.col("url"), prefix)), q, k)
    return nearest(chunks, q, k).where(under_prefix(F.col("url"), prefix))


def _closest(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Position of each query, and ids and exact distances of its k nearest of a batch, ties by id."""
    norms = np.einsum("ij,ij->i", vectors, vectors)
    for at in range(0, len(queries), BLOCK):
        block = queries[at : at + BLOCK]
        rough = norms - 2 * block @ vectors.T + np.einsum("ij,ij->i", block, block)[:, None]
        last = np.partition(rough, k - 1, axis=1)[:, k - 1] if k < len(ids) else rough.max(axis=1)
        # the product cancels digits, so all that may be among the k by the exact, rounded distance stay
        slack = 2e-6 + 1e-9 * np.abs(rough).max(axis=1)
        for i, row in enumerate(rough):
            near = np.flatnonzero(row <= last[i] + slack[i])
            difference = vectors[near] - block[i]
            exact = np.round(np.einsum("ij,ij->i", difference, difference), 6)
            best = np.lexsort((ids[near], exact))[:k]
            yield at + i, ids[near][best], exact[best]


def batch_nearest(chunks: DataFrame, queries: DataFrame, k: int = 10, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, sub_id, distance, rank of the k nearest of each query (query_id, q); rows without a vector are left out.

    Queries are dealt by hash to groups of about ``group_bytes``. Each group meets each Arrow batch of
    chunks as one matrix product, which leaves k rows a query; these alone are shuffled.
    """
    spark = chunks.sparkSession
    asked = queries.where("q is not null").select("query_id", F.col("q").cast("array<double>").alias("q"))
    size = asked.agg(F.sum(F.size("q") * 8).alias("n")).first().n or 0
    n = max(1, -(-size // group_bytes))
    rows = chunks.where("embedding is not null").select("sub_id", "embedding")
    kinds = [asked.schema["query_id"].dataType.simpleString(), rows.schema["sub_id"].dataType.simpleString()]
    schema = f"query_id {kinds[0]}, sub_id {kinds[1]}, distance double"

    def search(group: int) -> DataFrame:
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == group).toPandas()
        held = spark.sparkContext.broadcast((own["query_id"].to_numpy(), np.stack(own["q"].to_numpy()) if len(own) else np.empty((0, 0))))

        def nearest_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, matrix = held.value
            for batch in batches:
                if not len(batch) or not len(names):
                    continue
                found = list(_closest(np.stack(batch["embedding"].to_numpy()).astype(np.float64), batch["sub_id"].to_numpy(), matrix, k))
                counts = [len(ids) for _, ids, _ in found]
                yield pd.DataFrame({
                    "query_id": np.repeat(names[[at for at, _, _ in found]], counts),
                    "sub_id": np.concatenate([ids for _, ids, _ in found]),
                    "distance": np.concatenate([d for _, _, d in found]),
                })

        return rows.mapInPandas(nearest_of, schema)

    pairs = reduce(DataFrame.unionByName, [search(g) for g in range(n)])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "sub_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def rolled_up(hits: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """hits (sub_id, child_id, distance) to one row per parent: best sub-chunk per child, best child per parent.

    A child without a parent is its own, labelled standalone; a parent that is missing gives the child
    and an error label; hits of missing children are dropped.
    """
    own = hits.join(children.select("child_id", "parent_id"), "child_id")
    best = F.row_number().over(Window.partitionBy("child_id").orderBy("distance", "sub_id"))
    per_child = own.withColumn("r", best).where("r = 1").drop("r")
    known = parents.select(F.col("parent_id").alias("known"))
    named = per_child.join(known, F.col("parent_id") == F.col("known"), "left")
    label = F.when(F.col("parent_id").isNull(), "standalone").when(F.col("known").isNull(), "error: parent missing").otherwise("child->parent")
    named = named.withColumn("label", label).withColumn("context_id", F.coalesce("known", "child_id")).drop("known")
    first = F.row_number().over(Window.partitionBy("context_id", F.col("known_parent")).orderBy("distance", "sub_id"))
    return named.withColumn("known_parent", F.col("label") == "child->parent").withColumn("r", first).where("r = 1").drop("r", "known_parent")


def top_results(rows: DataFrame, k: int = RESULTS) -> DataFrame:
    return rows.withColumn("score", -F.col("distance")).orderBy(F.desc("score"), "sub_id").limit(k)


def lexical_overlap(query: Column, text: Column) -> Column:
    """Deterministic stand-in of a reranker: distinct query words that the text has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1)))
    return F.size(F.array_intersect(words(query), words(text))).cast("double")


def reranked(rows: DataFrame, query: Column, top_n: int = RESULTS, scorer: Callable[[Column, Column], Column] | None = lexical_overlap) -> DataFrame:
    """Best ``top_n`` by the scorer over breadcrumb and context; in the order given (column base_rank) without one."""
    if scorer is None:
        return rows.orderBy("base_rank").limit(top_n)
    doc = rerank_context(F.col("file_name"), F.col("header_path"), F.col("context_content"))
    return rows.withColumn("score", scorer(query, doc)).orderBy(F.desc("score"), "base_rank").limit(top_n)


def projected(rows: DataFrame) -> DataFrame:
    """The 14 result columns, in order."""
    name = F.coalesce(F.nullif(file_type(F.col("source_filename")), F.lit("")), F.nullif(file_type(F.col("file_name")), F.lit("")))
    return rows.select(
        "precise_content", "context_content", "score", F.col("file_name").alias("title"), "source_url", "header_path",
        deep_link(F.col("source_url"), name, F.col("page_number")).alias("file_url"), name.alias("file_type"),
        "search_text_start", "search_text_end", "page_number", "page_confidence", F.lit(None).cast("double").alias("html_confidence"), "node_hierarchy",
    )


def fused(corpus: DataFrame, knowledge: DataFrame, k: int = 10, scorer: Callable[[Column], Column] | None = None, top_n: int = RESULTS) -> DataFrame:
    """Two ranked branches (source, id, title, content, score) in one ranking: by score, or the best ``top_n`` by a scorer over the content."""
    named = knowledge.withColumn("title", F.concat(F.lit("[KB] "), "title"))
    rows = corpus.unionByName(named)
    if scorer is not None:
        rows, k = rows.withColumn("score", scorer(F.col("content"))), top_n
    return rows.orderBy(F.desc("score"), "source", "id").limit(k)


def article_results(chunks: DataFrame, base: str) -> DataFrame:
    """Chunks of knowledge-base articles (number, title, chunk, score) in the result columns."""
    none = F.lit(None).cast("string")
    return chunks.select(
        F.col("chunk").alias("precise_content"), F.col("chunk").alias("context_content"), "score", F.concat(F.lit("[KB] "), "title").alias("title"),
        none.alias("source_url"), F.lit("/").alias("header_path"), none.alias("file_url"), F.lit("kb").alias("file_type"), none.alias("search_text_start"),
        none.alias("search_text_end"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("double").alias("page_confidence"),
        F.lit(None).cast("double").alias("html_confidence"), F.lit(f"knowledge base {base}").alias("node_hierarchy"),
    )
