"""Queries over text, URL and Markdown functions and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..operators import chunking, filters, markdown
from ..sources.files import missing_conversions
from .registry import SQL, query, table

LINES = "SELECT doc_id, p - 1 AS pos, ls[p] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(generate_series(1, len(string_split(text, chr(10))))) AS p FROM documents)"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(text, '(?m)^#+\s*', '', 'g'), '\||-{3,}|\.{4,}|={3,}', ' ', 'g')),
 '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM documents""")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.normalize_for_comparison(F.col("text")).alias("norm"))


@query(r"""SELECT page_id, substr(sha256(concat_ws('|', trim(regexp_replace(lower(url), '\s+', ' ', 'g')), 'lib', 'a,b', 'fr', '15')), 1, 16) AS key FROM pages""")
def normalize_query_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    groups = F.array(F.lit("b"), F.lit("a"))
    return table(spark, sf, "pages").select("page_id", urls.cache_key(F.col("url"), F.lit("lib"), groups, F.lit("/fr/"), F.lit(15)).alias("key"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\s+([,.])', '\1', 'g'), '\s+', ' ', 'g')) AS spaced FROM documents""")
def punctuation_spacing(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.punctuation_spacing(F.col("text")).alias("spaced"))


@query("SELECT source, CAST(floor(sum(length(text) + length(lang) + length(source)) / 4) AS BIGINT) AS tokens FROM documents GROUP BY source")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(text.token_estimate(F.col("text"), F.col("lang"), F.col("source")).alias("tokens"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in text.FRENCH_STOPWORDS)


@query(rf"""SELECT conv_id, turn, CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE text END AS keywords FROM (SELECT conv_id, turn, text,
 list_filter(regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}_]+)', 1), lambda w: NOT list_contains([{_STOP}], w)) AS k FROM conversations)""")
def stopword_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", text.keywords(F.col("text")).alias("keywords"))


@query()
def start_end_fragments(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.line_nodes(table(spark, sf, "documents")).withColumn("f", text.start_end_fragments(F.col("text")))
    return rows.select("doc_id", "pos", F.col("f.start").alias("start"), F.col("f.end").alias("end"))


@query()
def longest_clean_substring(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.longest_clean(F.col("text")).alias("clean"))


@query()
def filename_normalise(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.regexp_replace(F.substring("text", 1, 40), "[\\n/]", " "), F.lit(" (1).PDF"))
    return table(spark, sf, "documents").select("doc_id", name.alias("name")).withColumn("safe", urls.safe_filename("name"))


@query(r"""SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}_\s-]', '', 'g'), '[-\s]+', '-', 'g'), 1, 50) AS slug,
 array_to_string(list_transform(string_split(replace(p_name, '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS shown,
 CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN printf('%.2f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.2f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576.0) ELSE printf('%.2f GB', b / 1073741824.0) END AS bytes
 FROM (SELECT *, p_size::BIGINT * p_partkey * p_partkey AS b FROM part)""")
def slug_name_bytes(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("long") * F.col("p_partkey") * F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.display_name(F.col("p_name")).alias("shown"), text.human_bytes(size, "GB").alias("bytes"))


@query(rf"""SELECT page_id, CASE WHEN q = '' THEN bare ELSE split_part(bare, '?', 1) || '?' || array_to_string(list_transform(list_sort(list_transform(string_split(q, '&'),
 lambda p, i: {{'n': split_part(p, '=', 1), 'i': i, 'p': p}})), lambda x: x.p), '&') END AS url,
 array_to_string(list_concat(list_transform(CASE WHEN len(ps) > 0 AND regexp_matches(ps[-1], '(?i)\.(html?|php|asp)$') THEN ps[:-2] ELSE ps END, lambda p: substr(regexp_replace(p, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 100)), [substr(md5(url), 1, 8)]), '/') AS folder,
 'page_' || substr(md5(url), 1, 8) || '.html' AS page_file, regexp_replace(list_last(string_split(regexp_replace(path, '/+$', ''), '/')), '[^a-zA-Z0-9_.-]', '_', 'g') AS file, sha256(html) AS hash
 FROM (SELECT *, regexp_extract(bare, '\?(.*)$', 1) AS q, list_filter(string_split(path, '/'), lambda p: p <> '') AS ps FROM (SELECT *, regexp_replace(url, '#.*$', '') AS bare, {PATH} AS path FROM pages))""")
def url_normalise(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", urls.normalized(u).alias("url"), urls.folder_path(u).alias("folder"), urls.page_file_name(u).alias("page_file"), urls.file_name(u).alias("file"), urls.content_hash(F.col("html")).alias("hash")
    )


@query(rf"SELECT 'fr' AS prefix, count(*) FILTER (starts_with({PATH}, '/fr/')) AS n, count(*) AS total FROM pages UNION ALL SELECT 'f', count(*) FILTER (starts_with({PATH}, '/f/')), count(*) FROM pages")
def url_prefix_counts(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    one = lambda p: pages.agg(F.count_if(urls.under_prefix(F.col("url"), p)).alias("n"), F.count(F.lit(1)).alias("total")).select(F.lit(p).alias("prefix"), "n", "total")
    return one("fr").unionByName(one("f"))


@query(rf"""SELECT page_id, starts_with(regexp_replace(url, '#.*$', ''), 'https://') AND NOT regexp_matches(url, '(?i){'|'.join(urls.EXCLUDED)}') AS allowed,
 regexp_matches(lower({PATH}), '\.({'|'.join(urls.DOWNLOADABLE)})$') AS download, NOT regexp_matches(url, '(?i)^(javascript|mailto|tel):') AS follow FROM pages""")
def link_allowed(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.crawlable(u, ["https://"]).alias("allowed"), urls.downloadable(u).alias("download"), urls.followable(u).alias("follow"))


_TOC = " OR ".join(f"contains(lower(text), '{w}')" for w in filters.TOC_WORDS)


@query(rf"""SELECT doc_id, contains(text, '|') OR d > 0.08 OR s > 0.30 OR length(text) > 15000 OR {_TOC} AS suspect FROM (SELECT doc_id, text,
 coalesce((length(text) - length(replace(text, '.', '')))::DOUBLE / nullif(length(text), 0), 0) AS d, coalesce((length(text) - length(replace(text, ' ', '')))::DOUBLE / nullif(length(text), 0), 0) AS s FROM documents)""")
def toc_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", filters.maybe_toc(F.col("text")).alias("suspect"))


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 8000 THEN text ELSE substr(text, 1, 4000) || chr(10) || chr(10) || '[... ' || (length(text) - 8000) || ' chars removed ...]' || chr(10) || chr(10) || right(text, 4000) END AS cut FROM documents""")
def toc_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.truncate_middle(F.col("text")).alias("cut"))


@query("SELECT doc_id FROM documents WHERE length(text) > 500 AND len(string_split(text, chr(10))) >= 5")
def empty_node_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(filters.not_empty(F.col("text"), 500, 5)).select("doc_id")


@query(rf"""WITH l AS ({LINES}), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, trim(line) ORDER BY pos) AS n FROM l)
 SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM k WHERE n = 1 GROUP BY doc_id""")
def md_dedup_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Every line counts as a header here: the tables have none."""
    return markdown.first_of_repeated(table(spark, sf, "documents"), mark="")


@query(rf"""WITH l AS ({LINES}), c AS (SELECT doc_id, pos, CASE
 WHEN contains(line, '|') AND regexp_full_match(trim(line), '[\s|\-_=:]+') THEN CASE WHEN length(trim(line)) - length(replace(trim(line), '|', '')) >= 2
  THEN '| ' || rtrim(repeat('--- | ', length(trim(line)) - length(replace(trim(line), '|', '')) - 1)) ELSE trim(line) END
 WHEN contains(line, '|') THEN trim(regexp_replace(regexp_replace(line, '\s*\|\s*', ' | ', 'g'), '\s+', ' ', 'g'))
 WHEN regexp_full_match(trim(line), '[\s\-_=.]+') THEN CASE WHEN contains(line, '-') THEN '---' WHEN contains(line, '_') THEN '___' WHEN contains(line, '=') THEN '===' WHEN contains(line, '.') THEN '...' ELSE trim(line) END
 ELSE regexp_replace(line, '\s{{3,}}', '  ', 'g') END AS line FROM l),
 o AS (SELECT doc_id, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS clean FROM c GROUP BY doc_id)
 SELECT doc_id, clean, round(coalesce((length(text) - length(clean)) * 100.0::DOUBLE / nullif(length(text), 0), 0), 6) AS reduction FROM o JOIN documents USING (doc_id)""")
def md_whitespace_clean(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").withColumn("clean", markdown.whitespace_cleaned(F.col("text")))
    return rows.select("doc_id", "clean", F.round(markdown.reduction(F.col("text"), F.col("clean")), 6).alias("reduction"))


@query(f"""WITH t AS (SELECT (SELECT sum(length(text)) FROM documents)::BIGINT AS before_chars, (SELECT sum(length(clean)) FROM ({SQL['md_whitespace_clean']}))::BIGINT AS after_chars)
 SELECT *, round((before_chars - after_chars) * 100.0::DOUBLE / before_chars, 4) AS reduction FROM t""")
def md_size_totals(spark: SparkSession, sf: str) -> DataFrame:
    clean = markdown.whitespace_cleaned(F.col("text"))
    return markdown.size_totals(table(spark, sf, "documents").select(F.col("text").alias("before"), clean.alias("after")))


@query(rf"""WITH l AS ({LINES}), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, trim(line) ORDER BY pos) AS n FROM l)
 SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM k WHERE n = 1 OR NOT regexp_matches(trim(line), '^D') GROUP BY doc_id""")
def md_dedup_marked(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that begin with a mark (here D) are headers and stay once; other lines may repeat."""
    return markdown.first_of_repeated(table(spark, sf, "documents"), mark="D")


def _lined(*parts: str | Column) -> Column:
    """Texts (strings) and columns, one below the other; null columns are empty."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def _marked_up(docs: DataFrame) -> DataFrame:
    """Documents with headers of several levels round them, and a fence."""
    title, lang, body = F.concat(F.lit("# "), F.coalesce("source", F.lit(""))), F.concat(F.lit("## "), F.coalesce("lang", F.lit(""))), F.col("text")
    return docs.select("doc_id", _lined("intro", title, body, lang, "```", "# no header", "```", "### Deep", body, "## Last", "# End").alias("text"))


@query(r"""WITH d AS (SELECT doc_id, concat_ws(chr(10), 'intro', '# ' || coalesce(source, ''), coalesce(text, ''), '## ' || coalesce(lang, ''), '```', '# no header', '```', '### Deep', coalesce(text, ''), '## Last', '# End') AS text FROM documents),
 l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
 f AS (SELECT *, starts_with(ltrim(line), '```') AS fence, sum(starts_with(ltrim(line), '```')::INT) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS fenced FROM l),
 h AS (SELECT *, NOT fence AND NOT fenced AND regexp_matches(line, '^#+\s') AS head FROM f),
 s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h),
 o AS (SELECT doc_id, section, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS text, max(line) FILTER (head) AS head FROM s GROUP BY doc_id, section),
 g AS (SELECT doc_id, section, text, coalesce(length(regexp_extract(head, '^(#+)', 1)), 0) AS level, coalesce(trim(regexp_extract(head, '^#+\s(.*)$', 1)), '') AS title FROM o),
 a AS (SELECT g.doc_id, g.section, string_agg(p.title, '/' ORDER BY p.section) AS path FROM g JOIN g p ON p.doc_id = g.doc_id AND p.section < g.section AND p.level > 0 AND p.level < g.level
  WHERE NOT EXISTS (SELECT 1 FROM g x WHERE x.doc_id = g.doc_id AND x.section > p.section AND x.section < g.section AND x.level <= p.level) GROUP BY g.doc_id, g.section)
 SELECT g.doc_id, (row_number() OVER (PARTITION BY g.doc_id ORDER BY g.section) - 1)::INT AS ord, level::INT AS level, title, coalesce('/' || path || '/', '/') AS header_path, text
 FROM g LEFT JOIN a ON a.doc_id = g.doc_id AND a.section = g.section WHERE text <> ''""")
def md_sections(spark: SparkSession, sf: str) -> DataFrame:
    return markdown.sections(_marked_up(table(spark, sf, "documents")))


@query(r"""WITH d AS (SELECT doc_id, concat_ws(chr(10), CASE WHEN doc_id % 3 = 0 THEN '# Top' END, '## SECTION ' || coalesce(source, ''), '## Chapitre 2', '## Article ' || doc_id || ' b', '## Other', coalesce(text, '')) AS text FROM documents),
 l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM d),
 f AS (SELECT *, len(list_filter(ls, lambda x: regexp_matches(trim(x), '^##([^#]|$)'))) > 0 AND len(list_filter(ls, lambda x: regexp_matches(trim(x), '^#([^#]|$)|^###'))) = 0 AS flat FROM l)
 SELECT doc_id, flat, CASE WHEN NOT flat THEN text ELSE array_to_string(list_transform(ls, lambda x: CASE
  WHEN regexp_matches(trim(x), '(?i)^## SECTION\s') THEN '# ' || substr(trim(x), 4) WHEN regexp_matches(trim(x), '(?i)^## (CHAPITRE|TITRE)\s') THEN trim(x)
  WHEN regexp_matches(trim(x), '(?i)^## Art(icle)?\.?\s+\d+') THEN '### ' || substr(trim(x), 4) ELSE x END), chr(10)) END AS text FROM f""")
def md_hierarchy_fix(spark: SparkSession, sf: str) -> DataFrame:
    top = F.when(F.col("doc_id") % 3 == 0, "# Top")
    id_ = F.concat(F.lit("## Article "), F.col("doc_id").cast("string"), F.lit(" b"))
    section = F.concat(F.lit("## SECTION "), F.coalesce("source", F.lit("")))
    parts = F.concat_ws("\n", top, section, F.lit("## Chapitre 2"), id_, F.lit("## Other"), F.coalesce("text", F.lit("")))
    rows = table(spark, sf, "documents").select("doc_id", parts.alias("text"))
    return rows.select("doc_id", markdown.is_flat(F.col("text")).alias("flat"), markdown.repaired(F.col("text")).alias("text"))


@query(rf"""WITH l AS ({LINES}) SELECT doc_id, count(*) FILTER (NOT contains(line, 'the')) AS kept_lines, count(*) FILTER (regexp_matches(line, '\||-{{4,}}|\.{{5,}}|_{{4,}}')) AS tables,
 count(*) FILTER (regexp_matches(line, '[.,;:!?''"()-]')) AS marked FROM l GROUP BY doc_id""")
def line_predicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("doc_id").agg(
        F.count_if(filters.without_marks(F.col("line"), "the")).alias("kept_lines"), F.count_if(filters.table_like(F.col("line"))).alias("tables"), F.count_if(text.has_punctuation(F.col("line"))).alias("marked")
    )


@query(rf"SELECT page_id FROM pages WHERE NOT list_has_any(string_split({PATH}, '/'), ['en', 'de'])")
def language_drop(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where(~filters.in_folder(urls.url_path(F.col("url")), "en", "de")).select("page_id")


@query("""SELECT doc_id, '[Document: ' || source || ' | Section: ' || lang || ' > x]' || chr(10) || chr(10) || text AS doc, source || ' > ' || lang AS crumbs FROM documents""")
def breadcrumb_context(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/"), "lang", F.lit("/x/"))
    meta = F.create_map(F.lit("Header 1"), F.col("lang"), F.lit("other"), F.lit("no"))
    return table(spark, sf, "documents").select("doc_id", text.rerank_context(F.col("source"), path, F.col("text")).alias("doc"), text.header_breadcrumbs(F.col("source"), meta).alias("crumbs"))


@query("SELECT conv_id, turn, 'Title: ' || role || chr(10) || 'KB: ' || conv_id || chr(10) || 'Content: ' || text AS chunk FROM conversations")
def kb_chunk_context(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", text.kb_chunk(F.col("role"), F.col("conv_id").cast("string"), F.col("text")).alias("chunk"))


@query(r"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN conv_id || ',' || turn ELSE '' END AS ids,
 CASE WHEN turn % 3 = 2 THEN 'General' ELSE coalesce(replace(trim(regexp_replace(text, '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s\p{Z}-]', '', 'g')), ' ', '_'), 'General') END AS folder FROM conversations""")
def kb_id_category(spark: SparkSession, sf: str) -> DataFrame:
    """Id lists as they are written by hand, and every turn's text as a folder's name."""
    turns = table(spark, sf, "conversations")
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("['"), F.col("conv_id").cast("string"), F.lit("', \""), F.col("turn").cast("string"), F.lit("\"]")))
    category = F.when(F.col("turn") % 3 != 2, F.col("text"))
    return turns.select("conv_id", "turn", text.kb_ids(raw).alias("ids"), text.safe_category(category).alias("folder"))


@query("SELECT doc_id, text AS fixed FROM documents")
def mojibake_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the documents read in the wrong code come back; the others stay."""
    docs = table(spark, sf, "documents")
    raw = F.when(F.col("doc_id") % 2 == 0, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    return docs.select("doc_id", text.repair_mojibake(raw).alias("fixed"))


@query(r"""SELECT vec_id, round(v, 2) AS score FROM (SELECT vec_id, vec_id * 0.013::DOUBLE + 0.0001::DOUBLE AS v FROM embeddings)""")
def score_round(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", text.score_rounded(F.col("vec_id") * F.lit(0.013) + F.lit(0.0001)).alias("score"))


# HTML


@query()
def html_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.clean_text("html").alias("text"))


@query()
def html_elements(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", F.explode(html.elements("html")).alias("e"))
    return rows.select("page_id", "e.*")


@query(r"""SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<(p|h[1-6])>', 1)) AS tag FROM (SELECT regexp_replace(html, '(?s)<script>.*?</script>', '', 'g') AS html FROM pages)) GROUP BY tag""")
def html_element_counts(spark: SparkSession, sf: str) -> DataFrame:
    return html_elements(spark, sf).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, i - 1 AS pos, ms[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS ms, unnest(generate_series(1, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS i FROM pages)""")
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(html.links("html")).alias("pos", "l"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("l.href").alias("href"))


@query()
def html_links_resolved(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", "url", F.explode(html.links("html")).alias("l"))
    return rows.select("page_id", urls.normalized_strict(urls.resolved(F.col("l.href"), F.col("url"))).alias("url"), F.col("l.text").alias("text"))


@query()
def kb_html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.kb_text("html").alias("text"))


@query()
def html_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("Reference: "), "url", F.lit("\n\n"), html.to_markdown("html")).alias("markdown"))


@query()
def soft_sanitise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.sanitised("html").alias("html"))


COLLAPSIBLE = """<body><p>shown</p><button data-toggle="collapse" data-target="#c1" aria-expanded="false">Open me</button><div id="c1" class="collapse"><p>folded</p></div>
<details><summary>More</summary><p>inner</p></details><details open><p>open</p></details><div aria-hidden="true"><p>aria</p></div><div class="d-none"><p>none</p></div><div class="collapse show"><p>shown too</p></div></body>"""


@query("""SELECT page_id, pos, t.text || ' ' || url AS text, visible, title || ' ' || url AS title FROM pages, (VALUES (0, 'shown', true, NULL), (1, 'folded', false, 'Open me'), (2, 'inner', false, 'More'), (3, 'open', true, NULL), (4, 'aria', false, NULL), (5, 'none', false, NULL), (6, 'shown too', true, NULL)) t(pos, text, visible, title)""")
def visible_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's address in folded, hidden and open places."""
    address = F.concat(F.lit(" "), F.replace("url", F.lit("&"), F.lit("&amp;")))
    page = F.lit(COLLAPSIBLE)
    for mark in ("</p>", "</button>", "</summary>"):
        page = F.replace(page, F.lit(mark), F.concat(address, F.lit(mark)))
    rows = table(spark, sf, "pages").select("page_id", F.explode(html.elements(page)).alias("e"))
    return rows.select("page_id", "e.pos", "e.text", "e.visible", "e.title")


@query()
def header_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(html.anchors("html")).alias("a")).select("page_id", "a.*")


@query(r"""WITH l AS (SELECT row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, * FROM part) SELECT p_brand AS stem, count(*) AS files, count(*) FILTER (n > 1) AS duplicates FROM l GROUP BY p_brand""")
def duplicate_basename(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    files = part.select(F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit("/"), "p_brand").alias("path"), F.lit("pdf").alias("ext"), F.col("p_brand").alias("stem"))
    out = filters.file_outcomes(files, part.limit(0).select(F.col("p_name").alias("path")))
    return out.groupBy("stem").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("outcome") == "duplicate").alias("duplicates"))


@query("""SELECT CASE WHEN doc_id % 10 = 0 THEN 'rejected' WHEN labelled THEN 'converted' WHEN n > 1 THEN 'duplicate' ELSE 'accepted' END AS outcome, count(*) AS n FROM (
 SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled, row_number() OVER (PARTITION BY source, l.doc_id IS NOT NULL, d.doc_id % 10 = 0 ORDER BY d.doc_id) AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) GROUP BY 1""")
def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("doc_id").cast("string").alias("path")
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), path, F.when(F.col("doc_id") % 10 == 0, "DOC").otherwise("pdf").alias("ext"), F.col("source").alias("stem"))
    return filters.file_outcomes(files, table(spark, sf, "labels").select(path).distinct()).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS missing FROM documents d ANTI JOIN labels USING (doc_id) GROUP BY lang")
def missing_conversion(spark: SparkSession, sf: str) -> DataFrame:
    path = lambda ending: F.concat(F.lit("library/"), F.col("doc_id").cast("string"), F.lit(ending)).alias("path")
    sources = table(spark, sf, "documents").select("lang", path(".PDF"))
    missing = missing_conversions(sources, table(spark, sf, "labels").select(path(".md")))
    return missing.groupBy("lang").agg(F.count(F.lit(1)).alias("missing"))

