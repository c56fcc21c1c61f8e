"""Snapshot diffs, crawl state, caches, access control, metadata checks and size roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Snapshots and crawling


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both: url, hash, folder, title. Removed rows keep the old folder and title."""
    a = old.select("url", *[F.col(c).alias(f"old_{c}") for c in ("hash", "folder", "title")], F.lit(True).alias("was"))
    b = new.select("url", "hash", "folder", "title", F.lit(True).alias("is"))
    no_hash = F.col("old_hash").isNull() | F.col("hash").isNull()
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(no_hash, "changed").when(F.col("old_hash") != F.col("hash"), "changed").otherwise("unchanged")
    rows = a.join(b, "url", "full").withColumn("status", status)
    reason = F.when((F.col("status") == "changed") & no_hash, "no_hash_available").when(F.col("status") == "changed", "content_changed")
    return rows.select(
        "url", "status", reason.alias("reason"), F.coalesce("folder", "old_folder").alias("folder"), F.coalesce("title", "old_title").alias("title"),
        F.col("status").isin("added", "changed").alias("reindex"),
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("reindex").alias("n_reindex"))


def frontier_next(candidates: DataFrame, visited: DataFrame, queued: DataFrame, documents_per_page: int = 50) -> DataFrame:
    """Links (page, url, pos) that are neither visited nor queued, at most 50 per page, each once in order."""
    per_page = F.row_number().over(Window.partitionBy("page").orderBy("pos"))
    few = candidates.withColumn("r", per_page).where(F.col("r") <= documents_per_page).drop("r")
    new = few.join(visited, "url", "left_anti").join(queued, "url", "left_anti")
    once = F.row_number().over(Window.partitionBy("url").orderBy("page", "pos"))
    return new.withColumn("r", once).where("r = 1").drop("r")


def failure_report(failed: DataFrame, samples: int = 10) -> DataFrame:
    """error, n, pct, samples (first ids) of failures (id, error)."""
    rank = F.row_number().over(Window.partitionBy("error").orderBy("id"))
    few = failed.withColumn("r", rank).where(F.col("r") <= samples).groupBy("error").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("samples"))
    counts = failed.groupBy("error").agg(F.count(F.lit(1)).alias("n"))
    pct = F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4)
    return counts.withColumn("pct", pct).join(few, "error")


def crawl_summary(visits: DataFrame) -> DataFrame:
    """visited, failed, sites and the last visit of visits (site, failed, at)."""
    return visits.agg(F.count(F.lit(1)).alias("visited"), F.count_if("failed").alias("failed"), F.countDistinct("site").alias("sites"), F.max("at").alias("last"))


def count_match(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Rows of both listings, and whether they are as many."""
    counts = remote.agg(F.count(F.lit(1)).alias("remote")).join(local.agg(F.count(F.lit(1)).alias("local")))
    return counts.withColumn("same", F.col("remote") == F.col("local"))


# Files


def file_inventory(files: DataFrame) -> DataFrame:
    """ext, n, bytes, pct, largest of files (path, size); the first path wins among equals."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.withColumn("ext", F.when(ext == "", "none").otherwise(ext))
    largest = F.min_by("path", F.struct(-F.col("size"), F.col("path")))
    per = rows.groupBy("ext").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), largest.alias("largest"))
    return per.withColumn("pct", F.round(F.col("bytes") * 100.0 / F.sum("bytes").over(Window.partitionBy()), 4))


def depth_rollup(files: DataFrame, depth: int = 2) -> DataFrame:
    """folder, n, bytes, running of files (path, size) at a path depth, or one less where paths are shorter."""
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.when(F.size(parts) > depth, depth).otherwise(F.greatest(F.size(parts) - 1, F.lit(1)))), "/")
    per = files.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return per.withColumn("running", F.sum("bytes").over(Window.orderBy("folder").rowsBetween(Window.unboundedPreceding, 0)))


# Access


def may_list(groups: Column, user: list[str]) -> Column:
    """Open without groups or with "public", else any common group; case doesn't matter. A null list is closed."""
    low = F.transform(groups, lambda g: F.lower(g))
    own = F.array(*[F.lit(u.lower()) for u in user]).cast("array<string>")
    return F.coalesce((F.size(low) == 0) | F.array_contains(low, "public") | F.arrays_overlap(low, own), F.lit(False))


def may_search(groups: Column, user: list[str]) -> Column:
    """The strict variant: no groups, or a common group in the same case."""
    own = F.array(*[F.lit(u) for u in user]).cast("array<string>")
    return F.coalesce((F.size(groups) == 0) | F.arrays_overlap(groups, own), F.lit(False))


# Cache


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (request_id, key) with hit and the cached results, if any."""
    return requests.join(cache.select("key", "results", F.lit(True).alias("hit")), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_kept(entries: DataFrame, most: int = 10_000) -> DataFrame:
    """The most recently used entries (key, last_used)."""
    return entries.orderBy(F.desc("last_used"), "key").limit(most)


def cache_stats(log: DataFrame) -> DataFrame:
    """hits, misses, hit_rate of a log (hit)."""
    hits, n = F.count_if("hit"), F.count(F.lit(1))
    return log.agg(hits.alias("hits"), (n - hits).alias("misses"), F.round(F.coalesce(F.try_divide(hits * 100.0, n), F.lit(0.0)), 2).alias("hit_rate"))


# Nodes and metadata


def node_classes(nodes: DataFrame) -> DataFrame:
    """nodes (node_id, parent_id) with kind: parent, orphan, child or sub-chunk."""
    up = nodes.select(F.col("node_id").alias("up_id"), F.col("parent_id").alias("up_parent"))
    kind = F.when(F.col("parent_id").isNull(), "PARENT").when(F.col("up_id").isNull(), "ORPHAN").when(F.col("up_parent").isNotNull(), "SUB-CHUNK").otherwise("CHILD")
    return nodes.join(up, F.col("parent_id") == F.col("up_id"), "left").withColumn("kind", kind).drop("up_id", "up_parent")


def nodes_per_document(files: DataFrame) -> DataFrame:
    """documents and nodes per file name of files (file_name, nodes)."""
    return files.groupBy("file_name").agg(F.count(F.lit(1)).alias("documents"), F.sum("nodes").alias("nodes"))


def coverage(rows: DataFrame, fields: list[str], by: str) -> DataFrame:
    """field, <by>, present, total, pct, status of fields that are neither null nor empty."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias("there")) for f in fields])).alias("x")
    per = rows.select(by, each).groupBy("x.field", by).agg(F.count_if("x.there").alias("present"), F.count(F.lit(1)).alias("total"))
    pct = F.round(F.col("present") * 100.0 / F.col("total"), 4)
    status = F.when(F.col("pct") > 90, "OK").when(F.col("pct") > 0, "PARTIAL").otherwise("MISSING")
    return per.withColumn("pct", pct).withColumn("status", status)


def backfilled(nodes: DataFrame, sidecars: DataFrame) -> DataFrame:
    """nodes (node_id, file_name, source_url) with missing URLs from sidecars (file_name, url), and an outcome."""
    side = sidecars.groupBy("file_name").agg(F.min("url").alias("side_url"))
    had = F.col("source_url").isNotNull() & (F.col("source_url") != "")
    outcome = F.when(had, "kept").when(F.col("side_url").isNotNull(), "filled").otherwise("unfixable")
    return nodes.join(side, "file_name", "left").withColumn("outcome", outcome).withColumn("source_url", F.when(had, F.col("source_url")).otherwise(F.col("side_url"))).drop("side_url")


def resolved_urls(files: DataFrame, pages: DataFrame, downloads: DataFrame, uploads: DataFrame) -> DataFrame:
    """files (file_name, kind) with url: page metadata for html, downloads for others, then uploads; null if none."""
    a = pages.select("file_name", F.col("url").alias("u1"))
    b = downloads.select("file_name", F.col("url").alias("u2"))
    c = uploads.select("file_name", F.col("url").alias("u3"))
    rows = files.join(a, "file_name", "left").join(b, "file_name", "left").join(c, "file_name", "left")
    own = F.when(F.col("kind") == "html", F.col("u1")).otherwise(F.col("u2"))
    origin = F.when(own.isNotNull(), F.when(F.col("kind") == "html", "page").otherwise("download")).when(F.col("u3").isNotNull(), "upload").otherwise("none")
    return rows.select("file_name", "kind", F.coalesce(own, "u3").alias("url"), origin.alias("origin"))


def kv_cache(models: DataFrame, seq_len: int = 32_768) -> DataFrame:
    """Bytes of keys and values of models (name, hidden_size, layers, heads, kv_heads, head_dim, dtype)."""
    table = F.create_map(*[F.lit(x) for pair in {"float32": 4.0, "float16": 2.0, "bfloat16": 2.0, "int8": 1.0, "int4": 0.5}.items() for x in pair])
    size = F.coalesce(F.try_element_at(table, F.coalesce("dtype", F.lit(""))), F.lit(4.0))
    dim = F.coalesce("head_dim", F.when(F.col("heads") > 0, F.expr("hidden_size div heads")).otherwise(0))
    total = 2.0 * F.col("layers") * seq_len * F.coalesce("kv_heads", "heads") * dim * size
    return models.select("name", total.alias("bytes"), F.round(total / 1024**2, 2).alias("mb"), F.round(total / 1024**3, 2).alias("gb"))
