"""Search requests against a built library: gates, access, cache, retrieval, roll-up, ranking and projection."""

from __future__ import annotations

import hmac
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import cache_key
from ..operators import search
from ..operators.diagnostics import may_list
from .cache import ResultCache
from .index import PLACE
from .kb import hashed_words
from .store import Library

CACHED = "position int, child_id string, context_id string, score double"


class Refused(Exception):
    """A request that is turned away, with an HTTP status."""

    def __init__(self, status: int, reason: str) -> None:
        super().__init__(reason)
        self.status = status


@dataclass(frozen=True)
class Request:
    query: str
    top_k: int = search.RESULTS
    rerank: bool = True
    url_prefix: str | None = None
    groups: tuple[str, ...] = ()
    key: str | None = None
    password: str | None = None


@dataclass(frozen=True)
class Gate:
    """What requests have to bring: the service's key, and the library's password if it has one."""

    key: str | None
    password: str | None = None


def check_key(given: str | None, expected: str | None) -> None:
    if given is None:
        raise Refused(422, "no key")
    if not expected:
        raise Refused(500, "no key is set up")
    if not hmac.compare_digest(given.encode(), expected.encode()):
        raise Refused(403, "wrong key")


def check_password(given: str | None, expected: str | None) -> None:
    """Libraries without a password are open."""
    if expected and given is None:
        raise Refused(401, "a password is needed")
    if expected and not hmac.compare_digest(given.encode(), expected.encode()):
        raise Refused(403, "wrong password")


def check_access(library: Library, groups: tuple[str, ...]) -> None:
    """By the library's table ``access`` (groups); without one it is open, with a null list closed."""
    if library.status()["status"] == "not_found" or not library._current("vectors"):
        raise Refused(404, "unknown library")
    rules = library.read("access", "groups array<string>")
    if rules.where(~may_list(F.col("groups"), list(groups))).take(1):
        raise Refused(403, "not among the groups")


def _one(library: Library, value: Column) -> object:
    return library.spark.range(1).select(value).first()[0]


def _in_full(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """found (child_id, context_id, ..) with the child's fields and both texts; rows whose nodes are gone are left out."""
    fields = PLACE | {"source_filename": "string", "page_number": "int"}
    own = [F.col(c).cast(t).alias(c) if c in nodes.columns else F.lit(None).cast(t).alias(c) for c, t in fields.items()]
    child = nodes.select(F.col("node_id").alias("child_id"), F.col("text").alias("precise_content"), "file_name", "source_url", "header_path", *own)
    context = nodes.select(F.col("node_id").alias("context_id"), F.col("text").alias("context_content"))
    return found.join(child, "child_id").join(context, "context_id")


def retrieved(library: Library, request: Request, embed: Callable[[Column], Column] = hashed_words) -> DataFrame:
    """One row per context, with base_rank from 1 and score: nearest sub-chunks rolled up, before any reranking."""
    nodes = library.read("hierarchy")
    vectors = library.vectors().select("sub_id", "child_id", F.col("source_url").alias("url"), "embedding")
    q = _one(library, embed(F.lit(request.query)))
    hits = search.nearest_with_prefix(vectors, q, request.url_prefix) if request.url_prefix else search.nearest(vectors, q)
    children = nodes.where("level = 'child'").select(F.col("node_id").alias("child_id"), "parent_id")
    rolled = search.rolled_up(hits.drop("url"), children, nodes.where("level = 'parent'").select(F.col("node_id").alias("parent_id")))
    rank = F.row_number().over(Window.orderBy("distance", "sub_id"))  # at most as many rows as hits
    return _in_full(rolled, nodes).withColumn("base_rank", rank).withColumn("score", -F.col("distance")).withColumn("node_hierarchy", F.col("label"))


def from_cache(library: Library, rows: list[tuple]) -> DataFrame:
    """Results of cached (child_id, context_id, score), in their order."""
    cached = library.spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], CACHED)
    full = _in_full(cached, library.read("hierarchy")).withColumn("node_hierarchy", F.lit("cached"))
    return search.projected(full.orderBy("position"))


def answer(library: Library, request: Request, embed: Callable[[Column], Column] = hashed_words, scorer: Callable[[Column, Column], Column] | None = search.lexical_overlap, cache: ResultCache | None = None, gate: Gate | None = None) -> DataFrame:
    """The result columns of a request, best first. Without reranking the cache is neither read nor written. A gate is asked first."""
    if gate is not None:
        check_key(request.key, gate.key)
        check_password(request.password, gate.password)
    check_access(library, request.groups)
    if not request.rerank:
        cache, scorer = None, None
    if cache is not None:
        filters = F.lit(request.url_prefix).cast("string")
        groups = F.array(*[F.lit(g) for g in request.groups]).cast("array<string>")
        key = _one(library, cache_key(F.lit(request.query), F.lit(library.library_id), groups, filters, F.lit(request.top_k)))
        key = f"{key}@{library.version()}"  # ids are positions: another version's entries are not this one's
        if (rows := cache.get(key)) is not None:
            return from_cache(library, rows)
    best = search.reranked(retrieved(library, request, embed), F.lit(request.query), request.top_k, scorer)
    if cache is None:
        return search.projected(best)
    taken = best.select("child_id", "context_id", "score", "node_hierarchy").collect()  # at most top_k rows
    cache.put(key, [(r.child_id, r.context_id, r.score) for r in taken])
    held = library.spark.createDataFrame([(k, *r) for k, r in enumerate(taken)], f"{CACHED}, node_hierarchy string")
    return search.projected(_in_full(held, library.read("hierarchy")).orderBy("position"))
