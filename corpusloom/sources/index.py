"""Index build of libraries: Markdown documents to linked nodes, sub-chunks and vectors, published as tables.

``build`` makes all tables anew. ``update`` compares the documents' fingerprints with those of the
last build and cuts and embeds the added and changed ones only; their nodes and vectors replace the
earlier ones, and those of removed documents go, bucket by bucket of the tables.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import anchors, chunking, filters, markdown, reports
from ..operators.diagnostics import backfilled, snapshot_diff
from .kb import hashed_words
from .keyed import Commits
from .shared import small_batches
from .store import Library

#: Files that a backfill's report names at most.
UNFIXABLE = 1000
CARRY = ("file_name", "source_url", "header_path")


def prepared(docs: DataFrame) -> DataFrame:
    """docs (doc_id, file_name, source_url, text) with levels restored, repeated headers and alignment taken out."""
    return docs.withColumn("text", markdown.whitespace_cleaned(markdown.once(markdown.repaired(F.col("text")))))


def index_nodes(docs: DataFrame, classify: Callable[[Column], Column] | None = None, **limits: object) -> DataFrame:
    """The node table (children and parents with file_name, source_url, header_path) of documents; ``limits`` go to the cut of oversized nodes."""
    small_batches(docs.sparkSession)
    sections = filters.without_toc(markdown.sections(prepared(docs)), classify)
    return chunking.halves_linked(chunking.section_hierarchy(sections, CARRY), **limits)


#: What says where in its source a node's text stands; null where nothing was found.
PLACE = {"search_text_start": "string", "search_text_end": "string", "page_number": "long", "page_confidence": "double"}


def located(nodes: DataFrame, pages: DataFrame | None = None, elements: DataFrame | None = None) -> DataFrame:
    """A node table with PLACE: page numbers from the pages (doc_id, page, text) of children, text fragments from elements (see ``fragment_locations``)."""
    children = nodes.where("level = 'child'")
    found = nodes.withColumns({c: F.lit(None).cast(t) for c, t in PLACE.items()})
    if pages is not None:
        found = found.drop("page_number", "page_confidence").join(anchors.page_locations(children.select("doc_id", "node_id", "ord", "text"), pages), "node_id", "left")
    if elements is not None:
        own = anchors.fragment_locations(children.select("doc_id", "node_id", "text"), elements)
        found = found.drop("search_text_start", "search_text_end").join(own.drop("anchor_type"), "node_id", "left")
    return found.select(*nodes.columns, *PLACE)


def plain_nodes(docs: DataFrame) -> DataFrame:
    """The node table of plain texts, line by line, with the fields that nodes carry."""
    lines = docs.select("doc_id", "file_name", "source_url", F.lit("/").alias("header_path"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return chunking.section_hierarchy(lines.where(F.trim("text") != ""), CARRY)


def index_vectors(nodes: DataFrame, embed: Callable[[Column], Column] = hashed_words, size: int = 512, overlap: int = 50) -> DataFrame:
    """doc_id, sub_id, child_id, what children carry, text and embedding of the children's sub-chunks."""
    children = nodes.where("level = 'child'").select("doc_id", F.col("node_id").alias("child_id"), *CARRY, "text")
    subs = chunking.sub_chunks(children, size, overlap)
    return subs.withColumn("sub_id", F.concat_ws("/s/", "child_id", F.col("sub").cast("string"))).withColumn("embedding", embed(F.col("text"))).drop("sub")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hash, file_name, source_url: the hash is of all that goes into nodes. A column ``hash`` of the text, as crawls have it, saves reading texts; null there means unknown."""
    own = F.col("hash") if "hash" in docs.columns else F.sha2(F.concat(F.when(F.col("text").isNull(), "-").otherwise("+"), F.coalesce("text", F.lit(""))), 256)
    every = F.sha2(F.to_json(F.struct(own.alias("hash"), "file_name", "source_url")), 256)
    return docs.select("doc_id", F.when(own.isNotNull(), every).alias("hash"), "file_name", "source_url")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """url (the document's id), status, reason, reindex of two tables of fingerprints."""
    shaped = lambda df: df.select(F.col("doc_id").alias("url"), "hash", F.col("file_name").alias("folder"), F.col("source_url").alias("title"))
    return snapshot_diff(shaped(old), shaped(new))


Cut = Callable[[DataFrame], DataFrame]


def build(library: Library, docs: DataFrame, embed: Callable[[Column], Column] = hashed_words, classify: Callable[[Column], Column] | None = None, least: int = 1, cut: Cut | None = None, **limits: object) -> dict:
    """Writes ``hierarchy``, ``vectors`` and ``snapshot`` anew; the status tells the outcome.

    ``cut`` makes nodes of documents, by default ``index_nodes``. Vectors are made from the published
    nodes, so a lost executor repeats neither cleaning nor grouping. Fewer nodes than ``least`` fail
    and leave the earlier version. Cached results of earlier versions are not found any more.
    """
    started = time.time()
    library.set_status("indexing", started)
    try:
        library.keyed("hierarchy", "doc_id").overwrite(cut(docs) if cut else index_nodes(docs, classify, **limits), least)
        library.keyed("vectors", "doc_id").overwrite(index_vectors(library.read("hierarchy"), embed))
        library.keyed("snapshot", "doc_id").overwrite(fingerprints(docs))
        n = docs.select("doc_id").distinct().count()
    except Exception as error:
        library.set_status("failed", started, time.time(), error=str(error)[:1000])
        raise
    library.set_status("done", started, time.time(), n)
    return library.status()


def _merged(library: Library, due: DataFrame, stale: DataFrame, embed: Callable[[Column], Column], nodes_of: Cut) -> None:
    """Nodes, vectors and fingerprints of ``due`` in the place of what the documents ``stale`` (doc_id) had; the snapshot is committed last."""
    at = f"staged-{uuid.uuid4().hex}"
    made = nodes_of(due)
    made.write.parquet(f"{library.root}/{at}")
    nodes = library.spark.read.schema(made.schema).parquet(f"{library.root}/{at}")
    library.keyed("hierarchy", "doc_id").replace(stale, nodes, held=True)
    library.keyed("vectors", "doc_id").replace(stale, index_vectors(nodes, embed))
    library.keyed("snapshot", "doc_id").replace(stale, fingerprints(due))
    Commits(library.spark, library.root).delete(at)


def _changed(library: Library, docs: DataFrame, find: Callable[[DataFrame], DataFrame], embed: Callable[[Column], Column], nodes_of: Cut) -> dict:
    """Applies the changes (url, status, reindex) that ``find`` tells from the last snapshot; the number of documents by status."""
    started, at = time.time(), f"staged-{uuid.uuid4().hex}"
    library.set_status("indexing", started)
    try:
        find(library.keyed("snapshot", "doc_id").read()).write.parquet(f"{library.root}/{at}")
        diff = library.spark.read.parquet(f"{library.root}/{at}")
        counts = dict.fromkeys(("added", "changed", "removed", "unchanged"), 0) | {r.status: r["count"] for r in diff.groupBy("status").count().collect()}
        if counts["added"] + counts["changed"] + counts["removed"]:
            ids = lambda rows: rows.select(F.col("url").alias("doc_id"))
            due = docs.join(ids(diff.where("reindex")), "doc_id", "left_semi")
            _merged(library, due, ids(diff.where("status <> 'unchanged'")), embed, nodes_of)
        Commits(library.spark, library.root).delete(at)
        n = library.read("snapshot").count()
    except Exception as error:
        library.set_status("failed", started, time.time(), error=str(error)[:1000])
        raise
    library.set_status("done", started, time.time(), n)
    return counts


def update(library: Library, docs: DataFrame, embed: Callable[[Column], Column] = hashed_words, classify: Callable[[Column], Column] | None = None, cut: Cut | None = None, **limits: object) -> dict:
    """Brings a built library to ``docs``, the whole new listing; the number of documents by status.

    Leaves the same tables as a build of ``docs``. After a failure on the way the next update does the
    same documents again, to the same rows. A document's id names it once.
    """
    if not library._current("snapshot"):
        build(library, docs, embed, classify, cut=cut, **limits)
        return {"added": library.read("snapshot").count(), "changed": 0, "removed": 0, "unchanged": 0}
    return _changed(library, docs, lambda old: changes(old, fingerprints(docs)), embed, cut or (lambda due: index_nodes(due, classify, **limits)))


def apply_versions(library: Library, versions: DataFrame, embed: Callable[[Column], Column] = hashed_words, classify: Callable[[Column], Column] | None = None, cut: Cut | None = None, **limits: object) -> dict:
    """Applies versions of some documents (docs' columns, removed, at) to a built library: of each the newest, which may be its removal.

    Documents that aren't named stay. Versions that are applied again change nothing.
    """
    last = versions.groupBy("doc_id").agg(F.max_by(F.struct("*"), F.struct("at", ~F.col("removed"))).alias("v")).select("v.*")
    present = last.where(~F.col("removed")).drop("removed", "at")

    def find(old: DataFrame) -> DataFrame:
        named = old.join(last.select("doc_id"), "doc_id", "left_semi")
        return changes(named, fingerprints(present))

    return _changed(library, present, find, embed, cut or (lambda due: index_nodes(due, classify, **limits)))


def backfill_urls(library: Library, sidecars: DataFrame, dry_run: bool = False) -> dict:
    """Fills missing source URLs of a library's nodes and vectors from sidecars (file_name, url); the number of nodes by outcome, and the files that have none.

    Only documents with filled nodes are rewritten, and none in a dry run.
    """
    nodes = library.read("hierarchy")
    judged = backfilled(nodes, sidecars)
    counts = {r.outcome: r.nodes for r in reports.backfill_report(judged).collect()}
    lost = [r.file_name for r in reports.unfixable_files(judged).orderBy(F.desc("nodes"), "file_name").limit(UNFIXABLE).collect()]
    if counts.get("filled") and not dry_run:
        stale = judged.where("outcome = 'filled'").select("doc_id").distinct()
        library.keyed("hierarchy", "doc_id").replace(stale, judged.join(stale, "doc_id", "left_semi").select(*nodes.columns))
        vectors = library.read("vectors")
        fixed = backfilled(vectors.join(stale, "doc_id", "left_semi"), sidecars).select(*vectors.columns)
        library.keyed("vectors", "doc_id").replace(stale, fixed)
    return dict.fromkeys(("kept", "filled", "unfixable"), 0) | counts | {"files": lost}


def rebuild_all(libraries: Iterable[Library], documents: Callable[[Library], DataFrame], exclude: Iterable[str] = (), stop_on_error: bool = False, **options: object) -> dict[str, str]:
    """One library after the other; outcome by library id: done, excluded, or failed with its error's kind."""
    outcomes: dict[str, str] = {}
    left_out = set(exclude)
    for library in libraries:
        if library.library_id in left_out:
            outcomes[library.library_id] = "excluded"
            continue
        try:
            outcomes[library.library_id] = build(library, documents(library), **options)["status"]
        except Exception as error:  # noqa: BLE001
            outcomes[library.library_id] = f"failed: {type(error).__name__}"
            if stop_on_error:
                break
    return outcomes
