"""Queries over snapshots, crawls, caches, access, inventories and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import diagnostics as D
from ..operators.crawl import breadth_first
from .registry import query, table

PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Old and new crawl of the pages: some dropped, altered, added, without a hash."""
    p = table(spark, sf, "pages").select("page_id", "url", urls.content_hash(F.col("html")).alias("hash"))
    old = p.where("page_id % 10 <> 0").select("url", F.when(F.col("page_id") % 7 == 0, None).otherwise(F.col("hash")).alias("hash"), F.concat(F.lit("old/"), F.col("page_id").cast("string")).alias("folder"), F.lit("Old").alias("title"))
    new = p.where("page_id % 11 <> 0").select("url", F.when(F.col("page_id") % 5 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")).alias("hash"), F.concat(F.lit("new/"), F.col("page_id").cast("string")).alias("folder"), F.lit("New").alias("title"))
    return old, new


DIFF = """o AS (SELECT url, CASE WHEN page_id % 7 = 0 THEN NULL ELSE sha256(html) END AS hash, 'old/' || page_id AS folder FROM pages WHERE page_id % 10 <> 0),
 n AS (SELECT url, CASE WHEN page_id % 5 = 0 THEN sha256(html) || 'x' ELSE sha256(html) END AS hash, 'new/' || page_id AS folder FROM pages WHERE page_id % 11 <> 0),
 d AS (SELECT coalesce(n.url, o.url) AS url, CASE WHEN o.url IS NULL THEN 'added' WHEN n.url IS NULL THEN 'removed' WHEN o.hash IS NULL OR n.hash IS NULL OR o.hash <> n.hash THEN 'changed' ELSE 'unchanged' END AS status,
  o.hash IS NULL OR n.hash IS NULL AS no_hash, coalesce(n.folder, o.folder) AS folder, CASE WHEN n.url IS NULL THEN 'Old' ELSE 'New' END AS title FROM o FULL JOIN n ON o.url = n.url)"""


@query(f"WITH {DIFF} SELECT url, status, CASE WHEN status = 'changed' AND no_hash THEN 'no_hash_available' WHEN status = 'changed' THEN 'content_changed' END AS reason, folder, title, status IN ('added', 'changed') AS reindex FROM d")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return D.snapshot_diff(*_snapshots(spark, sf))


@query(f"WITH {DIFF} SELECT status, count(*) AS n, count(*) FILTER (status IN ('added', 'changed')) AS n_reindex FROM d GROUP BY status")
def snapshot_summary(spark: SparkSession, sf: str) -> DataFrame:
    return D.diff_summary(snapshot_diff(spark, sf))


@query("""WITH RECURSIVE e AS (SELECT page_id AS a, (page_id * 3 + k) % (SELECT count(*) FROM pages) AS b FROM pages, (VALUES (1), (2)) t(k)),
 f AS (SELECT 0::BIGINT AS page, 0 AS depth UNION SELECT e.b, f.depth + 1 FROM f JOIN e ON f.page = e.a WHERE f.depth < 15) SELECT page, min(depth)::INT AS depth FROM f GROUP BY page""")
def crawl_bfs(spark: SparkSession, sf: str) -> DataFrame:
    """Breadth-first over links, depth by depth; each round reads only the newest pages."""
    pages = table(spark, sf, "pages")
    edges = pages.select(F.col("page_id").alias("page"), F.explode(F.array(F.lit(1), F.lit(2))).alias("pos")).withColumn("url", (F.col("page") * 3 + F.col("pos")) % pages.count())
    return breadth_first(edges, spark.createDataFrame([(0,)], "url long")).select(F.col("url").alias("page"), "depth")


@query("""SELECT b AS url, page, pos FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY page, pos) AS r FROM (SELECT page_id AS page, k AS pos, (page_id * 3 + k) % (SELECT count(*) FROM pages) AS b FROM pages, generate_series(1, 60) t(k) WHERE k <= 50)
 WHERE b % 3 <> 0 AND b % 5 <> 0) WHERE r = 1""")
def crawl_frontier(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    links = pages.select(F.col("page_id").alias("page"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(60).cast("long"))).alias("pos")).withColumn("url", (F.col("page") * 3 + F.col("pos")) % pages.count())
    ids = pages.select(F.col("page_id").alias("url"))
    return D.frontier_next(links, ids.where("url % 3 = 0"), ids.where("url % 5 = 0")).select("url", "page", "pos")


@query("""WITH f AS (SELECT event_id AS id, event_type AS error FROM events WHERE value > 50), c AS (SELECT error, count(*) AS n FROM f GROUP BY error),
 s AS (SELECT error, array_to_string(list(id ORDER BY id)[1:10], ',') AS samples FROM f GROUP BY error) SELECT error, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 4) AS pct, samples FROM c JOIN s USING (error)""")
def failure_report(spark: SparkSession, sf: str) -> DataFrame:
    return D.failure_report(table(spark, sf, "events").where("value > 50").select(F.col("event_id").alias("id"), F.col("event_type").alias("error")))


@query("SELECT count(*) AS visited, count(*) FILTER (event_type = 'error') AS failed, count(DISTINCT user_id) AS sites, max(event_id) AS last FROM events")
def crawl_summary(spark: SparkSession, sf: str) -> DataFrame:
    return D.crawl_summary(table(spark, sf, "events").select(F.col("user_id").alias("site"), (F.col("event_type") == "error").alias("failed"), F.col("event_id").alias("at")))


FILES = f"SELECT 'site' || {PATH} || CASE page_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.PDF' ELSE '' END AS path, length(html) AS size FROM pages"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, ".html").when(F.col("page_id") % 3 == 1, ".PDF").otherwise("")
    return table(spark, sf, "pages").select(F.concat(F.lit("site"), urls.url_path(F.col("url")), kind).alias("path"), F.length("html").cast("long").alias("size"))


@query(rf"""WITH f AS ({FILES}), e AS (SELECT *, CASE WHEN regexp_extract(path, '\.([^./]+)$', 1) = '' THEN 'none' ELSE lower(regexp_extract(path, '\.([^./]+)$', 1)) END AS ext FROM f)
 SELECT ext, count(*) AS n, sum(size)::BIGINT AS bytes, first(path ORDER BY size DESC, path) AS largest, round(sum(size) * 100.0::DOUBLE / sum(sum(size)) OVER (), 4) AS pct FROM e GROUP BY ext""")
def file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return D.file_inventory(_files(spark, sf))


@query(f"""WITH f AS ({FILES}), g AS (SELECT array_to_string(string_split(path, '/')[1:CASE WHEN len(string_split(path, '/')) > 2 THEN 2 ELSE greatest(len(string_split(path, '/')) - 1, 1) END], '/') AS folder, size FROM f)
 SELECT folder, count(*) AS n, sum(size)::BIGINT AS bytes, (sum(sum(size)) OVER (ORDER BY folder ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM g GROUP BY folder""")
def size_rollup_by_depth(spark: SparkSession, sf: str) -> DataFrame:
    return D.depth_rollup(_files(spark, sf))


@query("SELECT (SELECT count(*) FROM documents) AS remote, (SELECT count(DISTINCT doc_id) FROM labels) AS local, (SELECT count(*) FROM documents) = (SELECT count(DISTINCT doc_id) FROM labels) AS same")
def count_match(spark: SparkSession, sf: str) -> DataFrame:
    """Documents against the distinct ones that have labels."""
    return D.count_match(table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id").distinct())


@query("""SELECT c_custkey AS library_id, CASE c_custkey % 5 WHEN 1 THEN true WHEN 2 THEN true WHEN 4 THEN false ELSE lower(c_mktsegment) = 'building' END AS listed,
 CASE c_custkey % 5 WHEN 0 THEN c_mktsegment = 'BUILDING' WHEN 2 THEN true ELSE false END AS searchable FROM customer""")
def acl_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Groups as customers' segments, in capitals or not, public, none, or unreadable (null), which is closed."""
    seg, k = F.col("c_mktsegment"), F.col("c_custkey") % 5
    groups = F.when(k == 0, F.array(seg)).when(k == 1, F.array(F.lit("PUBLIC"))).when(k == 2, F.array().cast("array<string>")).when(k == 3, F.array(F.lower(seg), F.lit("x")))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("library_id"), groups.alias("groups"))
    return rows.select("library_id", D.may_list(F.col("groups"), ["building"]).alias("listed"), D.may_search(F.col("groups"), ["BUILDING"]).alias("searchable"))


@query("""SELECT label AS library_id, count(*) AS n, label % 3 = 0 AS is_public FROM embeddings WHERE label % 3 = 0 OR label = 4 GROUP BY label""")
def library_listing(spark: SparkSession, sf: str) -> DataFrame:
    acl = spark.createDataFrame([(k, ["public"] if k % 3 == 0 else ["team4"] if k == 4 else ["x"]) for k in range(10)], "label int, groups array<string>")
    rows = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(acl, "label")
    return rows.where(D.may_list(F.col("groups"), ["Team4"])).select(F.col("label").alias("library_id"), "n", F.array_contains(F.transform("groups", lambda g: F.lower(g)), "public").alias("is_public"))


LOG = "r AS (SELECT event_id, user_id % 97 AS k FROM events), c AS (SELECT k, max(event_id) AS last_used FROM r WHERE event_id % 2 = 0 GROUP BY k ORDER BY last_used DESC, k LIMIT 60)"


def _cache(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    r = table(spark, sf, "events").select("event_id", (F.col("user_id") % 97).alias("key"))
    kept = D.cache_kept(r.where("event_id % 2 = 0").groupBy("key").agg(F.max("event_id").alias("last_used")), 60)
    return r, kept


@query(f"WITH {LOG} SELECT k AS key, last_used FROM c")
def cache_lru_evict(spark: SparkSession, sf: str) -> DataFrame:
    return _cache(spark, sf)[1]


@query(f"WITH {LOG} SELECT event_id, r.k AS key, c.k IS NOT NULL AS hit, c.last_used AS results FROM r LEFT JOIN c ON r.k = c.k")
def cache_lookup_join(spark: SparkSession, sf: str) -> DataFrame:
    log, kept = _cache(spark, sf)
    return D.cache_lookup(log, kept.withColumnRenamed("last_used", "results"))


@query(f"WITH {LOG} SELECT count(c.k) AS hits, count(*) - count(c.k) AS misses, round(count(c.k) * 100.0::DOUBLE / count(*), 2) AS hit_rate FROM r LEFT JOIN c ON r.k = c.k")
def cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    return D.cache_stats(cache_lookup_join(spark, sf))


@query("""WITH d AS (SELECT d.lang, l.quality, CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE d.source END AS source, CASE WHEN l.toxic = 1 THEN 'x' END AS flag FROM documents d LEFT JOIN labels l USING (doc_id)),
 x AS (SELECT 'quality' AS field, lang, quality IS NOT NULL AS p FROM d UNION ALL SELECT 'source', lang, source <> '' FROM d UNION ALL SELECT 'flag', lang, flag IS NOT NULL FROM d),
 a AS (SELECT field, lang, count(*) FILTER (p) AS present, count(*) AS total FROM x GROUP BY field, lang)
 SELECT *, round(present * 100.0::DOUBLE / total, 4) AS pct, CASE WHEN present * 100.0 / total > 90 THEN 'OK' WHEN present > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS status FROM a""")
def metadata_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = rows.select("lang", "quality", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("source"), F.when(F.col("toxic") == 1, "x").alias("flag"))
    return D.coverage(rows, ["quality", "source", "flag"], "lang")


@query("SELECT quality, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def metadata_pivot(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rows.groupBy("quality").pivot("lang", ["en", "fr", "de"]).agg(F.count(F.lit(1))).select("quality", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("en", "fr", "de")])


@query("""WITH s AS (SELECT source AS file_name, min('http://s/' || doc_id) AS side FROM documents WHERE doc_id % 7 = 0 GROUP BY source)
 SELECT doc_id AS node_id, source AS file_name, CASE WHEN doc_id % 2 = 0 THEN 'http://own/' || doc_id ELSE side END AS source_url, CASE WHEN doc_id % 2 = 0 THEN 'kept' WHEN side IS NOT NULL THEN 'filled' ELSE 'unfixable' END AS outcome
 FROM documents LEFT JOIN s ON source = file_name""")
def backfill_url(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    own = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("http://own/"), F.col("doc_id").cast("string")))
    nodes = docs.select(F.col("doc_id").alias("node_id"), F.col("source").alias("file_name"), own.alias("source_url"))
    side = docs.where("doc_id % 7 = 0").select(F.col("source").alias("file_name"), F.concat(F.lit("http://s/"), F.col("doc_id").cast("string")).alias("url"))
    return D.backfilled(nodes, side).select("node_id", "file_name", "source_url", "outcome")


@query("""SELECT 'f' || page_id AS file_name, kind, CASE WHEN kind = 'html' AND page_id % 3 = 0 OR kind = 'pdf' AND page_id % 5 = 0 THEN url WHEN page_id % 7 = 0 THEN 'up/' || page_id END AS url,
 CASE WHEN kind = 'html' AND page_id % 3 = 0 THEN 'page' WHEN kind = 'pdf' AND page_id % 5 = 0 THEN 'download' WHEN page_id % 7 = 0 THEN 'upload' ELSE 'none' END AS origin FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN 'html' ELSE 'pdf' END AS kind FROM pages)""")
def url_resolution(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").withColumn("file_name", F.concat(F.lit("f"), F.col("page_id").cast("string")))
    files = p.select("file_name", F.when(F.col("page_id") % 2 == 0, "html").otherwise("pdf").alias("kind"))
    uploads = p.where("page_id % 7 = 0").select("file_name", F.concat(F.lit("up/"), F.col("page_id").cast("string")).alias("url"))
    return D.resolved_urls(files, p.where("page_id % 3 = 0"), p.where("page_id % 5 = 0"), uploads)


@query("SELECT source AS file_name, count(*) AS documents, sum(len(string_split(text, chr(10))))::BIGINT AS nodes FROM documents GROUP BY source")
def nodes_per_document(spark: SparkSession, sf: str) -> DataFrame:
    return D.nodes_per_document(table(spark, sf, "documents").select(F.col("source").alias("file_name"), F.size(F.split("text", "\n")).alias("nodes")))


@query("""SELECT name, b AS bytes, round(b / 1048576, 2) AS mb, round(b / 1073741824, 2) AS gb FROM (SELECT p_partkey AS name, 2.0::DOUBLE * p_size * 32768 * CASE WHEN p_partkey % 3 = 0 THEN 8 ELSE 32 END * CASE WHEN p_partkey % 4 = 0 THEN 128 ELSE p_size * 64 // 32 END
 * CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 0.5 WHEN 2 THEN 1 ELSE 4 END AS b FROM part)""")
def kv_cache_sizing(spark: SparkSession, sf: str) -> DataFrame:
    """Models in the sizes of parts: some without own key heads or head size, some of an unknown type."""
    k = F.col("p_partkey")
    kind = F.when(k % 5 == 0, "bfloat16").when(k % 5 == 1, "int4").when(k % 5 == 2, "int8").when(k % 5 == 3, "unknown")
    models = table(spark, sf, "part").select(
        k.alias("name"), (F.col("p_size") * 64).alias("hidden_size"), F.col("p_size").alias("layers"), F.lit(32).alias("heads"),
        F.when(k % 3 == 0, 8).alias("kv_heads"), F.when(k % 4 == 0, 128).alias("head_dim"), kind.alias("dtype"),
    )
    return D.kv_cache(models)


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS n FROM s GROUP BY user_id""")
def search_sessions(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))


@query()
def filename_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Renames that the filename rule asks for."""
    names = table(spark, sf, "part").select(F.concat(F.initcap("p_name"), F.lit(" é.PDF")).alias("name")).distinct()
    return names.withColumn("safe", urls.safe_filename("name")).where("safe <> name")

