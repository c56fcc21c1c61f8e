"""Queries over what keeps state: keyed stores, incremental builds, the result cache, the crawl's frontier."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.remote import remote
from ..sources import index
from ..sources.cache import ResultCache
from ..sources.docstore import migrate_docstore
from ..sources.shared import new_folder
from ..sources.store import Library
from ..streaming import frontier
from .registry import query, table
from .retrieval_queries import PARENTS



def _model(payloads: list[str]) -> list[int]:
    """A stand-in of a remote model that can't answer to some texts."""
    if any(len(p) % 11 == 0 for p in payloads):
        raise ConnectionError("no answer")
    return [2 * len(p) for p in payloads]


@query("SELECT doc_id, CASE WHEN length(text) % 11 <> 0 THEN 2 * length(text) END AS answer, CASE WHEN length(text) % 11 = 0 THEN 'ConnectionError' END AS error FROM documents")
def remote_calls(spark: SparkSession, sf: str) -> DataFrame:
    """All documents sent to a model with planted failures, eight at a time."""
    asked = remote(_model, "bigint", size=8, retries=1, wait=0.0)
    rows = table(spark, sf, "documents").select("doc_id", asked(F.col("text")).alias("asked"))
    return rows.select("doc_id", "asked.answer", "asked.error")


FEW = 8  # buckets of the queries' libraries


def _library(spark: SparkSession, name: str) -> Library:
    return Library(spark, new_folder(spark, name), "library", FEW)


@query("""SELECT doc_id::VARCHAR AS key, CASE WHEN doc_id % 7 = 0 THEN 'third' WHEN doc_id % 3 = 0 THEN 'second, last' ELSE coalesce(source, '') || ':' || coalesce(length(text), 0) END AS value FROM documents WHERE doc_id % 10 <> 0
 UNION ALL SELECT 'new-' || doc_id, 'third' FROM documents WHERE doc_id % 50 = 0""")
def store_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Three upserts, of which one repeats keys and one brings new ones, and a delete."""
    docs, store = table(spark, sf, "documents"), _library(spark, "store")
    key = F.col("doc_id").cast("string").alias("key")
    store.put_all(docs.select(key, F.concat(F.coalesce("source", F.lit("")), F.lit(":"), F.coalesce(F.length("text"), F.lit(0)).cast("string")).alias("value")))
    twice = F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.lit(n).alias("at")) for n, v in ((2, "second, last"), (1, "second, first"))]))
    store.put_all(docs.where("doc_id % 3 = 0").select(key, twice.alias("x")).select("key", "x.*"), by="at")
    third = docs.where("doc_id % 7 = 0").select(key).unionByName(docs.where("doc_id % 50 = 0").select(F.concat(F.lit("new-"), key).alias("key")))
    store.put_all(third.withColumn("value", F.lit("third")))
    store.keyed("nodes").delete(docs.where("doc_id % 10 = 0").select(key))
    return store.get_all()


NEW = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'revised ' || doc_id ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)"


@query(f"""WITH RECURSIVE {PARENTS.replace("FROM documents", f"FROM {NEW}")} SELECT doc_id || '/c/' || ord AS node_id, 'child' AS level, text FROM c
 UNION ALL SELECT doc_id || '/p/' || grp, 'parent', string_agg(line, chr(10) || chr(10) ORDER BY pos) FROM m2 GROUP BY doc_id, grp""")
def index_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The node table after a build of one snapshot of the documents and an update to the next."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("file_name"), F.lit(None).cast("string").alias("source_url"), "text")
    revised = F.concat("text", F.lit("\nrevised "), F.col("doc_id").cast("string"))
    new = docs.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, revised).otherwise(F.col("text")))
    library = _library(spark, "incremental")
    index.update(library, docs.where("doc_id % 10 <> 0"), cut=index.plain_nodes)
    index.update(library, new, cut=index.plain_nodes)
    return library.read("hierarchy").select("node_id", "level", "text")


@query("""WITH r AS (SELECT event_id, user_id % 97 AS k FROM events), c AS (SELECT k, max(event_id) AS last FROM r WHERE event_id % 2 = 0 GROUP BY k ORDER BY last DESC, k::VARCHAR LIMIT 60)
 SELECT event_id, r.k::VARCHAR AS key, c.k IS NOT NULL AS hit, CASE WHEN c.k IS NOT NULL THEN 'c' || last END AS child_id, CASE WHEN c.k IS NOT NULL THEN round(last::DOUBLE / 8, 2) END AS score FROM r LEFT JOIN c ON r.k = c.k""")
def cache_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Entries in two appends to the log, compacted to the 60 last used, then all requests looked up."""
    log = table(spark, sf, "events").select("event_id", (F.col("user_id") % 97).cast("string").alias("key"))
    cache = ResultCache(_library(spark, "cache"), most=60)
    row = F.struct(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("child_id"), F.lit("p").alias("context_id"), (F.col("event_id").cast("double") / 8).alias("score"))
    for part in (0, 2):
        cache.put_all(log.where(F.col("event_id") % 4 == part).select("key", F.array(row).alias("rows"), F.col("event_id").cast("double").alias("last_used")))
    cache.compact()
    return cache.lookup(log).select("event_id", "key", "hit", F.col("rows")[0]["child_id"].alias("child_id"), F.col("rows")[0]["score"].alias("score"))


LINKS = "SELECT page_id AS page, k AS pos, (page_id * 3 + k) % (SELECT count(*) FROM pages) AS url, 1 + (k - 1) // 10 AS turn FROM pages, generate_series(1, 60) t(k)"


@query(f"""WITH l AS (SELECT *, turn * 1000000000 + page * 100 + pos AS seq FROM ({LINKS}) WHERE url % 3 <> 0), m AS (SELECT *, url % 7 = 0 AS fails, url % 7 = 0 AND seq > 3999999999 AS late FROM l),
 r AS (SELECT *, row_number() OVER (PARTITION BY url, late ORDER BY seq) AS n FROM m) SELECT url, CASE WHEN late THEN 2 ELSE 1 END::INT AS attempt, seq, page AS referrer FROM r WHERE n = 1""")
def crawl_state(spark: SparkSession, sf: str) -> DataFrame:
    """Links of all pages replayed in two runs from one checkpoint: some pages were visited before, some fail in between and are linked again."""
    pages = table(spark, sf, "pages").select("page_id")
    n = pages.count()
    k = F.sequence(F.lit(1).cast("long"), F.lit(60).cast("long"))
    links = pages.select(F.col("page_id").alias("page"), F.explode(k).alias("pos")).withColumn("url", (F.col("page") * 3 + F.col("pos")) % n).withColumn("at", 1 + F.expr("(pos - 1) div 10"))
    event = lambda df, kind, seq: df.select(
        F.concat(F.lit("host"), (F.col("url") % 4).cast("string")).alias("host"), F.col("url").cast("string").alias("url"), F.lit(kind).alias("kind"), seq.alias("seq"),
        F.timestamp_seconds(F.col("at")).alias("at"), F.col("page").cast("string").alias("referrer"), F.lit(None).cast("int").alias("depth"),
    )
    own = lambda test, at: pages.where(test).select(F.col("page_id").alias("url"), F.lit(None).cast("long").alias("page"), F.lit(at).alias("at"))
    found = event(links, "link", F.col("at") * 1_000_000_000 + F.col("page") * 100 + F.col("pos"))
    first = found.where("seq < 4000000000").unionByName(event(own("page_id % 3 = 0", 0), "visited", F.lit(0).cast("long"))).unionByName(event(own("page_id % 7 = 0", 3), "failed", F.lit(3_999_999_999)))
    at = new_folder(spark, "crawl")
    for part in (first, found.where("seq >= 4000000000")):
        part.write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(frontier.EVENT).parquet(f"{at}/in")
        frontier.crawled(frontier.frontier(stream), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.col("url").cast("long").alias("url"), "attempt", "seq", F.col("referrer").cast("long").alias("referrer"))


def _as_stores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One JSON document store of each partition's entries, line by line."""
    yield pd.DataFrame({"value": ['{"docstore/metadata": {}, "docstore/data": {']})
    comma = ""
    for batch in batches:
        if len(batch):
            lines = batch["entry"].tolist()
            yield pd.DataFrame({"value": [comma + lines[0], *("," + line for line in lines[1:])]})
            comma = ","
    yield pd.DataFrame({"value": ['}, "docstore/ref_doc_info": {}}']})


@query("""SELECT 'n' || doc_id AS key, '1' AS kind, text, CASE WHEN doc_id % 3 > 0 THEN 'n' || (doc_id - doc_id % 3) END AS parent_id, (SELECT count(*) FROM documents) AS nodes, (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS parents FROM documents""")
def docstore_migration(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as nodes of JSON stores, of which every third one is the next two's parent, migrated and read from the key/value table."""
    name = lambda k: F.concat(F.lit("n"), k.cast("string"))
    up = F.when(F.col("doc_id") % 3 > 0, name(F.col("doc_id") - F.col("doc_id") % 3))
    links = F.when(up.isNotNull(), F.create_map(F.lit("4"), F.struct(up.alias("node_id"))))
    data = F.to_json(F.struct(name(F.col("doc_id")).alias("id_"), "text", links.alias("relationships")), {"ignoreNullFields": "false"})
    entry = F.concat(F.lit('"'), name(F.col("doc_id")), F.lit('": {"__data__": '), data, F.lit(', "__type__": "1"}'))
    at, library = new_folder(spark, "docstore"), _library(spark, "migrated")
    table(spark, sf, "documents").select(entry.alias("entry")).mapInPandas(_as_stores, "value string").write.text(at)
    told = migrate_docstore(spark, at, library)
    if told["status"] != "success":
        raise RuntimeError(told)
    value = F.parse_json("value")
    field = lambda path: F.try_variant_get(value, path, "string")
    return library.get_all().select(
        "key", field("$.__type__").alias("kind"), field("$.__data__.text").alias("text"), field("$.__data__.relationships['4'].node_id").alias("parent_id"),
        F.lit(told["nodes"]).cast("long").alias("nodes"), F.lit(told["parent_nodes"]).cast("long").alias("parents"),
    )
