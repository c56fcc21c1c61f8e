"""Queries over chunking, anchors, vectors and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..functions.urls import under_prefix
from ..operators import anchors, chunking, diagnostics, names, search
from ..operators.cells import CellTable
from ..sources import index
from ..sources.shared import new_folder
from .registry import query, table

LINES = "SELECT doc_id, p - 1 AS pos, ls[p] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(generate_series(1, len(string_split(text, chr(10))))) AS p FROM documents)"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
DIST = "round(list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6)"
NEAR = f"SELECT vec_id AS sub_id, {DIST} AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def greedy(source: str, limit: int) -> str:
    """Recursive grouping from the last row (doc_id, pos, line) backwards."""
    return f"""b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS r FROM {source}),
 g AS (SELECT doc_id, pos, line, r, 0 AS k, length(line) AS used FROM b WHERE r = 1 UNION ALL
  SELECT b.doc_id, b.pos, b.line, b.r, CASE WHEN g.used + length(b.line) > {limit} THEN g.k + 1 ELSE g.k END, CASE WHEN g.used + length(b.line) > {limit} THEN length(b.line) ELSE g.used + length(b.line) END
  FROM g JOIN b ON b.doc_id = g.doc_id AND b.r = g.r + 1),
 m AS (SELECT doc_id, (max(k) OVER (PARTITION BY doc_id) - k)::INT AS grp, pos, line FROM g)"""


NODES = f"l AS (SELECT * FROM ({LINES}) WHERE trim(line) <> '')"
GROUPED = f"{NODES}, {greedy('l', 2000)}, c0 AS (SELECT doc_id, grp, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS text, count(*) AS n_nodes FROM m GROUP BY doc_id, grp)"
CHILDREN = f"""{GROUPED}, s AS (SELECT doc_id, grp, text, sum(CASE WHEN length(text) >= 200 OR grp = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS kept FROM c0),
 c AS (SELECT doc_id, kept::INT AS ord, string_agg(text, chr(10) || chr(10) ORDER BY grp) AS text FROM s GROUP BY doc_id, kept)"""
PARENTS = CHILDREN + ", " + greedy("(SELECT doc_id, ord AS pos, text AS line FROM c)", 5000).replace("b AS", "b2 AS").replace("FROM b ", "FROM b2 b ").replace("JOIN b ON", "JOIN b2 b ON").replace(" g AS", " g2 AS").replace("FROM g JOIN", "FROM g2 g JOIN").replace("m AS (", "m2 AS (").replace("line FROM g)", "line FROM g2)")


@query(f"WITH RECURSIVE {GROUPED} SELECT doc_id, grp AS ord, n_nodes, length(text) AS chars FROM c0")
def chunk_groups_child(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.merged(chunking.line_nodes(table(spark, sf, "documents")), chunking.CHILD_SIZE)
    return rows.select("doc_id", "ord", "n_nodes", F.length("text").cast("long").alias("chars"))


@query(f"WITH RECURSIVE {CHILDREN} SELECT doc_id, ord, text FROM c")
def chunk_children(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.children_of(table(spark, sf, "documents"))


@query(f"WITH RECURSIVE {PARENTS} SELECT doc_id, grp AS ord, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS text, count(*) AS n_children FROM m2 GROUP BY doc_id, grp")
def chunk_parents(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.with_parents(chunking.children_of(table(spark, sf, "documents")))[1]


@query(f"WITH RECURSIVE {CHILDREN} SELECT count(*) AS n, min(length(text)) AS least, max(length(text)) AS most, CAST(floor(avg(length(text))) AS BIGINT) AS mean FROM c")
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.size_stats(chunk_children(spark, sf))


@query(f"WITH l AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM ({LINES}) WHERE trim(line) <> ''), s AS (SELECT *, sum(CASE WHEN length(line) >= 200 OR r = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS kept FROM l) SELECT doc_id, kept::INT AS ord, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS text FROM s GROUP BY doc_id, kept")
def forced_small_merge(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.small_merged(chunking.line_nodes(table(spark, sf, "documents")).withColumnRenamed("pos", "ord"))


@query(f"""WITH RECURSIVE {PARENTS}, n AS (SELECT doc_id || '/c/' || pos AS node_id, 'child' AS level, doc_id, pos AS ord, doc_id || '/p/' || grp AS parent_id FROM m2
 UNION ALL SELECT DISTINCT doc_id || '/p/' || grp, 'parent', doc_id, grp, NULL FROM m2)
 SELECT node_id, level, parent_id, lag(node_id) OVER w AS prev_id, lead(node_id) OVER w AS next_id FROM n WINDOW w AS (PARTITION BY doc_id, level ORDER BY ord)""")
def prev_next_links(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.hierarchy(table(spark, sf, "documents")).select("node_id", "level", "parent_id", "prev_id", "next_id")


@query()
def oversized_split(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "documents").select("doc_id", "text")
    return chunking.split_oversized(nodes, tokens=4000)


@query()
def sub_chunks(spark: SparkSession, sf: str) -> DataFrame:
    nodes = chunking.hierarchy(table(spark, sf, "documents")).where("level = 'child'")
    return chunking.sub_chunks(nodes.select("node_id", "parent_id", "text"))


@query()
def recursive_split(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.recursive_split(table(spark, sf, "documents").select("doc_id", "text"))


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, pos, length(line) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM ({LINES}) WHERE trim(line) <> ''),
 f AS (SELECT doc_id, r, n AS chars, 0 AS grp, n >= 500 AS closed FROM l WHERE r = 1 UNION ALL
  SELECT l.doc_id, l.r, CASE WHEN NOT f.closed AND f.chars < 500 AND f.chars + l.n <= 5000 THEN f.chars + l.n ELSE l.n END, CASE WHEN NOT f.closed AND f.chars < 500 AND f.chars + l.n <= 5000 THEN f.grp ELSE f.grp + 1 END,
  CASE WHEN NOT f.closed AND f.chars < 500 AND f.chars + l.n <= 5000 THEN false ELSE l.n >= 500 END FROM f JOIN l ON l.doc_id = f.doc_id AND l.r = f.r + 1)
 SELECT f.doc_id, (min(f.r) - 1)::INT AS first, count(*)::INT AS n, max(chars) AS chars, string_agg(pos, ',' ORDER BY f.r) AS merged FROM f JOIN l ON f.doc_id = l.doc_id AND f.r = l.r GROUP BY f.doc_id, grp""")
def small_anchor_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.line_nodes(table(spark, sf, "documents"))
    found = chunking.small_anchors_merged(rows.select("doc_id", "pos", F.length("text").alias("chars")))
    return found.withColumn("merged", F.array_join(F.transform("merged", lambda x: x.cast("string")), ","))


def _page_nodes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes from the text elements of pages, the elements, and the elements as pages of a document."""
    e = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.explode(html.elements("html")).alias("e")).select("doc_id", "e.*")
    nodes = e.where("pos > 0 and length(text) > 0").select("doc_id", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("node_id"), F.col("pos").alias("ord"), "text")
    return nodes, e, e.select("doc_id", F.col("pos").alias("page"), "text")


@query()
def page_locator(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _, sheets = _page_nodes(spark, sf)
    return anchors.page_locations(nodes, sheets)


@query()
def fragment_locator(spark: SparkSession, sf: str) -> DataFrame:
    nodes, elements, _ = _page_nodes(spark, sf)
    return anchors.fragment_locations(nodes, elements)


@query()
def annotation_audit(spark: SparkSession, sf: str) -> DataFrame:
    nodes, elements, _ = _page_nodes(spark, sf)
    found = anchors.fragment_locations(nodes, elements)
    rows = nodes.select("node_id", F.lit("html").alias("ext"), F.lit("p").alias("parent_id"))
    kinds = anchors.anchored(rows, found, nodes.select("node_id", F.lit(None).cast("long").alias("page_number")).limit(0))
    return kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT p_partkey AS k, substr(md5(p_partkey::VARCHAR), 1, 28) || '.md' AS target FROM part), n AS (SELECT *, length(target) AS m, CASE WHEN k % 3 = 0 THEN 'copy of ' || target ELSE substr(target, 1, 5) || '~' || substr(target, 7) || '.pdf' END AS name FROM t),
 s AS (SELECT name, target, round(CASE WHEN k % 3 = 0 THEN 200.0::DOUBLE * m / (2 * m + 8) ELSE 200.0::DOUBLE * (m - 1) / (2 * m + 4) END) AS score FROM n) SELECT * FROM s WHERE score >= 85""")
def fuzzy_best_name(spark: SparkSession, sf: str) -> DataFrame:
    """Copies with slips of file names, one for each part, find the file they come from among all."""
    target = F.concat(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 28), F.lit(".md"))
    files = table(spark, sf, "part").select("p_partkey", target.alias("name"))
    slip = F.concat(F.substring("name", 1, 5), F.lit("~"), F.substring("name", 7, 200), F.lit(".pdf"))
    copies = files.select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("copy of "), "name")).otherwise(slip).alias("name"))
    return names.best_names(copies, files)


@query()
def index_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as Markdown, through the build's steps up to linked nodes."""
    name = F.concat(F.col("page_id").cast("string"), F.lit(".md"))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), name.alias("file_name"), F.col("url").alias("source_url"), html.to_markdown("html").alias("text"))
    return index.index_nodes(pages)


# Retrieval: sub_id = vec_id, child = vec_id div 2, parent = vec_id div 6


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("sub_id"), "embedding")


def _query(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    return search.query_vector(table(spark, sf, "embeddings"), vec_id)


def _with_url(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    n = pages.count()
    return _chunks(spark, sf).join(pages.select("page_id", "url"), F.col("sub_id") % n == F.col("page_id")).drop("page_id")


def _rollup(hits: DataFrame) -> DataFrame:
    rows = hits.withColumn("child_id", F.expr("sub_id div 2"))
    children = rows.select("child_id", F.expr("child_id div 3").alias("parent_id")).distinct()
    return search.rolled_up(rows, children, children.select("parent_id").distinct())


ROLLUP = """c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sub_id // 2 ORDER BY distance, sub_id) AS r FROM h) WHERE r = 1),
 p AS (SELECT * FROM (SELECT * EXCLUDE r, row_number() OVER (PARTITION BY sub_id // 6 ORDER BY distance, sub_id) AS r FROM c) WHERE r = 1)"""


@query(f"WITH h AS ({NEAR} ORDER BY distance, sub_id LIMIT 50), {ROLLUP} SELECT sub_id, sub_id // 2 AS child_id, sub_id // 6 AS parent_id, distance FROM p ORDER BY distance, sub_id LIMIT 15")
def search_topk_rollup(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.nearest(_chunks(spark, sf), _query(spark, sf))
    return search.top_results(_rollup(hits)).select("sub_id", "child_id", "parent_id", "distance")


@query(f"WITH h AS ({NEAR} ORDER BY distance DESC, sub_id LIMIT 50) SELECT sub_id, distance FROM h")
def search_farthest_compat(spark: SparkSession, sf: str) -> DataFrame:
    return search.nearest(_chunks(spark, sf), _query(spark, sf), farthest_first=True)


URLS = f"SELECT e.sub_id, e.distance, p.url FROM ({NEAR}) e JOIN pages p ON e.sub_id % (SELECT count(*) FROM pages) = p.page_id"


@query(f"SELECT sub_id, distance FROM (SELECT * FROM ({URLS}) ORDER BY distance, sub_id LIMIT 100) WHERE starts_with({PATH}, '/fr/')")
def search_url_filter_post(spark: SparkSession, sf: str) -> DataFrame:
    return search.nearest_with_prefix(_with_url(spark, sf), _query(spark, sf), "fr", 100).select("sub_id", "distance")


@query(f"SELECT sub_id, distance FROM ({URLS}) WHERE starts_with({PATH}, '/fr/') ORDER BY distance, sub_id LIMIT 100")
def search_url_filter_pre(spark: SparkSession, sf: str) -> DataFrame:
    return search.nearest_with_prefix(_with_url(spark, sf), _query(spark, sf), "fr", 100, before=True).select("sub_id", "distance")


@query(f"""SELECT * FROM (SELECT query_id, vec_id AS sub_id, {DIST} AS distance, row_number() OVER (PARTITION BY query_id ORDER BY {DIST}, vec_id)::INT AS rank FROM embeddings,
 (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)) WHERE rank <= 10""")
def search_batch_queries(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return search.batch_nearest(_chunks(spark, sf), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))


@query(f"SELECT sub_id, distance FROM ({NEAR}) ORDER BY distance, sub_id LIMIT 50")
def search_numpy_twin(spark: SparkSession, sf: str) -> DataFrame:
    return search.nearest(_chunks(spark, sf), _query(spark, sf), batch=True)


@query(f"WITH h AS ({NEAR} ORDER BY distance, sub_id LIMIT 50), {ROLLUP} SELECT sub_id, sub_id // 2 AS child_id, sub_id // 6 AS parent_id, distance FROM p ORDER BY distance, sub_id LIMIT 15")
def search_cells_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """search_topk_rollup from a table by cells, of which those too far away aren't read."""
    held = CellTable.write(_chunks(spark, sf), new_folder(spark, "cells"))
    return search.top_results(_rollup(held.nearest(_query(spark, sf), search.TOP))).select("sub_id", "child_id", "parent_id", "distance")


@query(f"SELECT sub_id, distance FROM ({URLS}) WHERE starts_with({PATH}, '/fr/') ORDER BY distance, sub_id LIMIT 1000")
def search_cells_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest 1,000 below a prefix, read cell by cell until there are as many."""
    held = CellTable.write(_with_url(spark, sf), new_folder(spark, "cells"))
    return held.nearest(_query(spark, sf), search.TOP_FILTERED, under_prefix(F.col("url"), "fr")).select("sub_id", "distance")


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS cosine FROM embeddings ORDER BY cosine DESC, vec_id LIMIT 20")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _query(spark, sf)])
    return table(spark, sf, "embeddings").select("vec_id", F.round(search.cosine(F.col("embedding"), q), 6).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(20)


@query(f"""WITH a AS (SELECT 'corpus' AS source, sub_id AS id, 'Vector ' || sub_id AS title, -distance AS score FROM ({NEAR} ORDER BY distance, sub_id LIMIT 20)),
 b AS (SELECT 'kb' AS source, conv_id AS id, '[KB] ' || substr(text, 1, 20) AS title, -round(length(text)::DOUBLE / 1000, 6) AS score FROM conversations WHERE turn = 0 ORDER BY score DESC, id LIMIT 20)
 SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY score DESC, source, id LIMIT 10""")
def hybrid_union_rank(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.nearest(_chunks(spark, sf), _query(spark, sf), 20)
    corpus = hits.select(F.lit("corpus").alias("source"), F.col("sub_id").alias("id"), F.concat(F.lit("Vector "), F.col("sub_id").cast("string")).alias("title"), (-F.col("distance")).alias("score"))
    score = -F.round(F.length("text").cast("double") / 1000, 6)
    kb = table(spark, sf, "conversations").where("turn = 0").select(F.lit("kb").alias("source"), F.col("conv_id").alias("id"), F.substring("text", 1, 20).alias("title"), score.alias("score"))
    return search.fused(corpus, kb.orderBy(F.desc("score"), "id").limit(20))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower('[Document: ' || coalesce(source, 'Unknown') || ' | Section: ' || lang || ']' || chr(10) || chr(10) || text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+') AS words FROM documents)
 SELECT doc_id, len(list_filter(['the', 'of', 'and', 'with'], lambda q: list_contains(words, q)))::DOUBLE AS score FROM w ORDER BY score DESC NULLS LAST, doc_id LIMIT 15""")
def rerank_lexical_stub(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("file_name"), F.concat(F.lit("/"), "lang", F.lit("/")).alias("header_path"), F.col("text").alias("context_content"), F.col("doc_id").alias("base_rank"))
    return search.reranked(rows, F.lit("the of and with")).select("doc_id", "score")


@query(f"""WITH h AS ({NEAR} ORDER BY distance, sub_id LIMIT 50) SELECT d.text AS precise_content, d.text AS context_content, -h.distance AS score, d.source || '.PDF' AS title, p.url AS source_url, '/' || d.lang || '/' AS header_path,
 CASE WHEN h.sub_id % 7 > 0 THEN p.url || '#page=' || (h.sub_id % 7) ELSE p.url END AS file_url, 'pdf' AS file_type, NULL::VARCHAR AS search_text_start, NULL::VARCHAR AS search_text_end, (h.sub_id % 7)::INT AS page_number,
 50.0::DOUBLE AS page_confidence, NULL::DOUBLE AS html_confidence, 'child->parent' AS node_hierarchy FROM h JOIN documents d ON d.doc_id = h.sub_id JOIN pages p ON p.page_id = h.sub_id % (SELECT count(*) FROM pages)""")
def result_projection(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.nearest(_chunks(spark, sf), _query(spark, sf))
    pages = table(spark, sf, "pages")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", F.col("source").alias("src"))
    rows = hits.join(docs, F.col("doc_id") == F.col("sub_id")).join(pages.select("page_id", "url"), F.col("sub_id") % pages.count() == F.col("page_id"))
    none = F.lit(None).cast("string")
    return search.projected(
        rows.select(
            F.col("text").alias("precise_content"), F.col("text").alias("context_content"), (-F.col("distance")).alias("score"), F.concat("src", F.lit(".PDF")).alias("file_name"), none.alias("source_filename"),
            F.col("url").alias("source_url"), F.concat(F.lit("/"), "lang", F.lit("/")).alias("header_path"), none.alias("search_text_start"), none.alias("search_text_end"),
            (F.col("sub_id") % 7).cast("int").alias("page_number"), F.lit(50.0).alias("page_confidence"), F.lit("child->parent").alias("node_hierarchy"),
        )
    )


@query()
def live_kb_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Articles by keyword, cleaned, split, embedded by a stand-in and ranked by cosine."""
    from ..sources import kb

    articles = table(spark, sf, "conversations").where("turn = 0").select(F.col("conv_id").cast("string").alias("number"), F.substring("text", 1, 30).alias("title"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"))
    return kb.live_search(articles, "the of thing", top_k=5)


NODE_SQL = "SELECT 'c' || (vec_id // 2) AS node_id, CASE WHEN vec_id % 10 < 8 THEN 'p' || (vec_id // 6) END AS parent_id FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 's' || vec_id, 'c' || (vec_id // 2) FROM embeddings UNION ALL SELECT DISTINCT 'p' || (vec_id // 6), NULL FROM embeddings WHERE vec_id % 100 > 10"


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    name = lambda k, div: F.concat(F.lit(k), F.expr(f"vec_id div {div}").cast("string"))
    none = F.lit(None).cast("string")
    child = e.where("vec_id % 2 = 0").select(name("c", 2).alias("node_id"), F.when(F.col("vec_id") % 10 < 8, name("p", 6)).alias("parent_id"))
    sub = e.select(name("s", 1).alias("node_id"), name("c", 2).alias("parent_id"))
    parent = e.where("vec_id % 100 > 10").select(name("p", 6).alias("node_id"), none.alias("parent_id")).distinct()
    return child.unionByName(sub).unionByName(parent)


CLASSES = f"WITH n AS ({NODE_SQL}), k AS (SELECT n.node_id, CASE WHEN n.parent_id IS NULL THEN 'PARENT' WHEN u.node_id IS NULL THEN 'ORPHAN' WHEN u.parent_id IS NOT NULL THEN 'SUB-CHUNK' ELSE 'CHILD' END AS kind FROM n LEFT JOIN n u ON n.parent_id = u.node_id)"


@query(f"{CLASSES} SELECT node_id, kind FROM k")
def node_classify(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.node_classes(_nodes(spark, sf)).select("node_id", "kind")


@query(f"{CLASSES} SELECT CASE kind WHEN 'ORPHAN' THEN 'CHILD' ELSE kind END AS kind, count(*) AS n FROM k GROUP BY 1")
def node_counts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("kind") == "ORPHAN", "CHILD").otherwise(F.col("kind"))
    return node_classify(spark, sf).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT [vec_id // 2, vec_id // 2 + 1, 100000] AS ids, vec_id FROM embeddings), x AS (SELECT vec_id, i - 1 AS pos, ids[i] AS child_id FROM c, generate_series(1, 3) t(i)),
 n AS (SELECT DISTINCT vec_id // 2 AS child_id, vec_id // 6 AS parent_id FROM embeddings) SELECT vec_id, pos, x.child_id, parent_id, 'cached' AS label FROM x JOIN n ON x.child_id = n.child_id""")
def cache_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Results again from cached ids, in their order; ids that are gone are skipped."""
    e = table(spark, sf, "embeddings")
    ids = F.array(F.expr("vec_id div 2"), F.expr("vec_id div 2") + 1, F.lit(100_000).cast("long"))
    cached = e.select("vec_id", F.posexplode(ids).alias("pos", "child_id"))
    nodes = e.select(F.expr("vec_id div 2").alias("child_id"), F.expr("vec_id div 6").alias("parent_id")).distinct()
    return cached.join(nodes, "child_id").select("vec_id", F.col("pos").cast("long").alias("pos"), "child_id", "parent_id", F.lit("cached").alias("label"))

