"""Queries over reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import anchors, diagnostics, filters, reports
from ..sources.files import missing_conversions
from .ops_queries import FILES, _files
from .registry import query, table


@query("""SELECT count(*) FILTER (event_id % 10 <> 0 AND event_type <> 'error') AS visited, count(*) FILTER (event_id % 10 <> 0 AND event_type = 'error') AS failed, count(*) FILTER (event_id % 10 = 0) AS remaining, max(event_id) AS ended FROM events""")
def crawl_report(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_id") % 10 == 0, "queued").when(F.col("event_type") == "error", "failed").otherwise("visited")
    return reports.crawl_report(table(spark, sf, "events").select(status.alias("status"), F.col("event_id").alias("at")))


@query(f"""WITH f AS (SELECT path, CASE WHEN size % 13 <> 0 THEN size END AS size FROM ({FILES})), d AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS dir FROM f, generate_series(1, 40) t(k) WHERE k < len(string_split(path, '/')))
 SELECT count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (size IS NULL) AS errors, (SELECT path FROM f WHERE size IS NOT NULL ORDER BY size DESC, path LIMIT 1) AS largest, (SELECT count(*) FROM d) AS dirs FROM f""")
def inventory_totals(spark: SparkSession, sf: str) -> DataFrame:
    return reports.inventory_totals(_files(spark, sf).withColumn("size", F.when(F.col("size") % 13 != 0, F.col("size"))))


ROWS = "SELECT d.doc_id, d.lang, CASE WHEN d.doc_id % 3 <> 0 THEN d.source END AS source, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return docs.select("doc_id", "lang", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"), "toxic")


@query(f"""WITH d AS ({ROWS}), n AS (SELECT 'lang' AS key, count(lang) AS n FROM d UNION ALL SELECT 'source', count(source) FROM d UNION ALL SELECT 'toxic', count(toxic) FROM d)
 SELECT key, n, round(n * 100.0::DOUBLE / (SELECT count(*) FROM d), 4) AS pct FROM n WHERE n > 0""")
def metadata_keys(spark: SparkSession, sf: str) -> DataFrame:
    names = ("lang", "source", "toxic")
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names])
    rows = _rows(spark, sf).select(F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("metadata"))
    return reports.key_frequency(rows)


@query(f"""WITH d AS ({ROWS}), x AS (SELECT doc_id, 'source' AS field FROM d WHERE coalesce(source, '') = '' UNION ALL SELECT doc_id, 'toxic' FROM d WHERE toxic IS NULL UNION ALL SELECT doc_id, 'lang' FROM d WHERE coalesce(lang, '') = '')
 SELECT field, count(*) AS missing, array_to_string(list(doc_id ORDER BY doc_id)[1:5], ',') AS samples FROM x GROUP BY field""")
def metadata_missing(spark: SparkSession, sf: str) -> DataFrame:
    return reports.missing_samples(_rows(spark, sf), ["lang", "source", "toxic"], "doc_id")


BACK = "SELECT page_id, 'f' || (page_id % 40) AS file_name, CASE WHEN page_id % 4 = 0 THEN 'kept' WHEN page_id % 40 < 25 THEN 'filled' ELSE 'unfixable' END AS outcome FROM pages"


def _backfilled(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").withColumn("file_name", F.concat(F.lit("f"), (F.col("page_id") % 40).cast("string")))
    nodes = pages.select(F.col("page_id").alias("node_id"), "file_name", F.when(F.col("page_id") % 4 == 0, F.col("url")).alias("source_url"))
    return diagnostics.backfilled(nodes, pages.where("page_id < 25").select("file_name", "url"))


@query(f"SELECT outcome, count(*) AS nodes, count(DISTINCT file_name) AS files FROM ({BACK}) GROUP BY outcome")
def backfill_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.backfill_report(_backfilled(spark, sf))


@query(f"SELECT file_name, count(*) AS nodes FROM ({BACK}) WHERE outcome = 'unfixable' GROUP BY file_name")
def backfill_unfixable(spark: SparkSession, sf: str) -> DataFrame:
    return reports.unfixable_files(_backfilled(spark, sf))


@query("""WITH m AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'float16' ELSE 'float32' END AS dtype, round(2.0::DOUBLE * p_size * 32768 * 8 * 64 * CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 4 END / 1048576, 2) AS mb FROM part)
 SELECT dtype, count(*) AS n, min(mb) AS least, max(mb) AS most, round(avg(mb), 2) AS mean FROM m GROUP BY dtype""")
def kv_cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 2 == 0, "float16").otherwise("float32")
    models = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.lit(512).alias("hidden_size"), F.col("p_size").alias("layers"), F.lit(8).alias("heads"), F.lit(8).alias("kv_heads"), F.lit(64).alias("head_dim"), kind.alias("dtype"))
    sized = diagnostics.kv_cache(models).join(models.select("name", "dtype"), "name")
    return reports.kv_cache_stats(sized)


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'html' END AS ext FROM documents), m AS (SELECT ext, count(*) AS files, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS missing FROM s GROUP BY ext)
 SELECT ext, files, files - missing AS converted, missing, round((files - missing) * 100.0::DOUBLE / files, 4) AS pct FROM m""")
def conversion_stats(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.element_at(F.array(F.lit("pdf"), F.lit("docx"), F.lit("html")), (F.col("doc_id") % 3 + 1).cast("int"))
    path = lambda ending: F.concat(F.lit("library/"), F.col("doc_id").cast("string"), F.lit("."), ending).alias("path")
    sources = table(spark, sf, "documents").select(ext.alias("ext"), path(ext))
    return reports.conversion_stats(sources, missing_conversions(sources, table(spark, sf, "labels").select(path(F.lit("md")))))


DATA = "replace(base64(encode('image ' || page_id)), chr(10), '')"


@query(f"""SELECT page_id, mode, CASE mode WHEN 'placeholder' THEN url || ' <!-- image --> ' || url WHEN 'referenced' THEN url || ' ![a b](images/' || sha256({DATA}) || '.png) ' || url ELSE url || ' ![a b](data:image/png;base64,' || {DATA} || ') ' || url END AS text FROM pages, (VALUES ('placeholder'), ('referenced'), ('embedded')) t(mode)""")
def image_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Converted text around an embedded image, in all three modes."""
    image = F.concat(F.lit("![a b](data:image/png;base64,"), F.base64(F.encode(F.concat(F.lit("image "), F.col("page_id").cast("string")), "UTF-8")), F.lit(")"))
    pages = table(spark, sf, "pages").select("page_id", F.concat_ws(" ", "url", image, "url").alias("text"))
    rows = [pages.select("page_id", F.lit(mode).alias("mode"), reports.images_as(F.col("text"), mode).alias("text")) for mode in reports.IMAGE_MODES]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"""WITH g AS (SELECT array_to_string(string_split(path, '/')[1:CASE WHEN len(string_split(path, '/')) > 2 THEN 2 ELSE greatest(len(string_split(path, '/')) - 1, 1) END], '/') AS folder, size FROM ({FILES})),
 f AS (SELECT folder, count(*) AS n, sum(size)::BIGINT AS bytes FROM g GROUP BY folder), m AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'failed' ELSE 'moved' END AS outcome, CASE WHEN n % 5 = 0 THEN 0 ELSE bytes END AS moved, n / 4.0::DOUBLE AS s FROM f),
 r AS (SELECT *, (sum(moved) OVER w)::BIGINT AS running, sum(s) OVER w AS time, (sum(bytes) OVER ())::BIGINT AS total FROM m WINDOW w AS (ORDER BY folder ROWS UNBOUNDED PRECEDING))
 SELECT folder, n, bytes, outcome, running, round(running * 100.0::DOUBLE / total, 4) AS pct, round(moved / s, 4) AS speed, CASE WHEN running > 0 THEN round((total - running) * time / running, 2) END AS eta FROM r""")
def transfer_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Folders at depth two, moved at a pace by their number of files; those of a multiple of five fail."""
    return reports.transfer_plan(diagnostics.depth_rollup(_files(spark, sf)).drop("running"), F.col("n") / F.lit(4.0), F.col("n") % 5 != 0)


@query("""SELECT page_id AS node_id FROM pages WHERE page_id % 10 <> 0 AND page_id % 3 <> 0 AND page_id % 5 <> 0""")
def unanchored_children(spark: SparkSession, sf: str) -> DataFrame:
    """Children that have neither a fragment nor a page."""
    k = F.col("page_id")
    nodes = table(spark, sf, "pages").select(k.alias("node_id"), F.when(k % 10 != 0, "p").alias("parent_id"), F.when(k % 3 == 0, urls.url_path(F.col("url"))).alias("search_text_start"), F.when(k % 5 == 0, k).alias("page_number"))
    return anchors.without_anchor(nodes).select("node_id")


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN 'invalid_pdf_signature' WHEN doc_id % 5 = 1 THEN 'invalid_pdf_signature' WHEN doc_id % 5 = 2 THEN 'pdf_no_pages' WHEN doc_id % 5 = 3 THEN 'pdf_validation_error' WHEN doc_id % 5 = 4 THEN 'pdf_unreadable' END AS reason FROM documents""")
def pdf_reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as PDFs, four of five broken: another signature, no pages, no catalog, a first page that doesn't inflate."""
    k = F.col("doc_id") % 5
    pick = lambda n, broken, whole: F.when(k == n, broken).otherwise(F.lit(whole))
    parts = [
        pick(1, "<html>", "%PDF-1.4"), F.lit("1 0 obj << /Type"), pick(3, "/Nothing", "/Catalog"), F.lit("/Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids"), pick(2, "[]", "[3 0 R]"),
        F.lit(">> endobj 3 0 obj << /Type /Page /Contents 4 0 R >> endobj 4 0 obj <<"), pick(4, "/Filter /FlateDecode", ""), F.lit(">> stream\nBT ("), F.col("text"), F.lit(") Tj ET\nendstream endobj"),
    ]
    content = F.encode(F.concat(*[x for part in parts for x in (part, F.lit(" "))]), "UTF-8")
    return table(spark, sf, "documents").select("doc_id", filters.pdf_reject_reason(content).alias("reason"))
