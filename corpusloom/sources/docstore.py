"""Migration of JSON document stores into a library's key/value tables.

A store is one JSON object of collections; the nodes are entries {"__data__": .., "__type__": ..} of
``docstore/data``. Quotes within JSON strings are escaped, so the text ``"__data__"`` occurs as a key
only: files are read as records between these keys, which Spark splits at any size, and no task
holds a whole file. A record has one node and, at its end, the next node's key; what precedes the
first node and follows the last one are the other collections, one row for each file.
Entries without the wrapper are read file by file.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diagnostics import node_classes
from .keyed import Commits
from .store import Library

# The format's collections, and keys of its entries.
DATA, REF_DOC, METADATA = "docstore/data", "docstore/ref_doc_info", "docstore/metadata"
MARK, KIND = '"__data__"', '"__type__"'
PARENT = "4"
BLANKS = " \t\n\r\f\v"
_TABLES = {REF_DOC: "ref_docs", METADATA: "metadata"}


def _records(spark: SparkSession, path: str) -> DataFrame:
    """file, before (up to the node's type), kind, tail (what follows the entry), whole of each record."""
    raw = spark.read.option("lineSep", MARK).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("whole"))
    before = F.substring_index("whole", KIND, 1)
    after = F.substr("whole", F.length(before) + len(KIND) + 1)
    end = r'^\s*:\s*"([^"]*)"\s*\}'
    node = F.startswith(F.ltrim(F.col("whole")), F.lit(":"))
    return raw.select("file", node.alias("node"), "whole", before.alias("before"), F.regexp_extract(after, end, 1).alias("kind"), F.regexp_replace(after, end, "").alias("tail"))


def _next_key(text: Column) -> Column:
    """The key that opens the next entry at the end of a text, as its JSON string; empty if there is none."""
    return F.regexp_extract(F.right(text, F.lit(4096)), r'("[^"\\]*+(?:\\.[^"\\]*+)*+")\s*:\s*\{\s*$', 1)


def _parsed(records: DataFrame) -> DataFrame:
    """file, node, key, value, parent, ok, opened, first, last of each record, from one reading of the text.

    The key is the node's own id, and ``opened`` the key in front of the next entry. ``first`` and ``last``
    are what a file has before its first and behind its last node.
    """
    # no pattern for trailing blanks: it would be tried at every blank of a text
    body = F.rtrim(F.regexp_replace("before", r"^\s*:\s*", ""), F.lit(BLANKS))
    data = F.rtrim(F.when(F.endswith(body, F.lit(",")), F.substr(body, F.lit(1), F.length(body) - 1)).otherwise(body), F.lit(BLANKS))
    opened = _next_key(F.when(F.col("node"), F.col("tail")).otherwise(F.col("whole")))
    rows = records.select("file", "node", "kind", F.when(F.col("node"), data).alias("data"), opened.alias("opened"), "whole", "tail").withColumn("v", F.try_parse_json("data"))
    value = F.concat(F.lit(f"{{{MARK}: "), F.col("data"), F.lit(f', {KIND}: "'), F.col("kind"), F.lit('"}'))
    first = F.when(~F.col("node"), F.regexp_replace("whole", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:\s*\{\s*$', ""))
    key = F.from_json(F.concat(F.lit('{"k":'), F.nullif("opened", F.lit("")), F.lit("}")), "k string")["k"]
    return rows.select(
        "file", "node", F.try_variant_get("v", "$.id_", "string").alias("key"), value.alias("value"), F.try_variant_get("v", f"$.relationships['{PARENT}'].node_id", "string").alias("parent"),
        F.col("v").isNotNull().alias("ok"), key.alias("opened"), first.alias("first"), F.when(F.col("node") & (F.col("opened") == ""), F.col("tail")).alias("last"),
    )


def _other(parsed: DataFrame) -> DataFrame:
    """file, rest: the collections other than the nodes, as a variant; null if the file's frame isn't JSON."""
    frame = parsed.select("file", "first", "last").where("first is not null or last is not null")
    per = frame.groupBy("file").agg(F.max("first").alias("first"), F.coalesce(F.max("last"), F.lit("")).alias("last"), F.count("last").alias("lasts"))
    return per.select("file", F.when(F.col("lasts") <= 1, F.try_parse_json(F.concat("first", "last"))).alias("rest"))


def _entries(rest: DataFrame, collection: str) -> DataFrame:
    found = rest.select(F.explode(F.try_variant_get("rest", f"$['{collection}']", "map<string,variant>")).alias("key", "value"))
    return found.select("key", F.to_json("value").alias("value"))


def _keys_agree(parsed: DataFrame) -> bool:
    """Whether the keys in front of the entries are the ids within, by sums of hashes per file."""
    own, front = F.when(F.col("node"), F.col("key")), F.col("opened")
    total = lambda c: F.sum(F.when(c.isNotNull(), F.xxhash64(c).cast("decimal(38,0)")))
    sums = parsed.groupBy("file").agg(F.count(own).alias("a"), F.count(front).alias("b"), total(own).alias("c"), total(front).alias("d"))
    return not sums.where("a <> b or not c <=> d").take(1)


def _with_parents(rows: DataFrame) -> DataFrame:
    """key, value, parent of (key, value)."""
    data = F.parse_json("value")
    up = F.coalesce(F.try_variant_get(data, f"$.__data__.relationships['{PARENT}'].node_id", "string"), F.try_variant_get(data, f"$.relationships['{PARENT}'].node_id", "string"))
    return rows.select("key", "value", up.alias("parent"))


def node_counts(rows: DataFrame) -> dict[str, int]:
    """parent_nodes, child_nodes and subchunks of (key, parent): a child's parent has none, a sub-chunk's has one."""
    kinds = node_classes(rows.select(F.col("key").alias("node_id"), F.col("parent").alias("parent_id"))).groupBy("kind").count().collect()
    found = {r.kind: r["count"] for r in kinds}
    return {"parent_nodes": found.get("PARENT", 0), "child_nodes": found.get("CHILD", 0) + found.get("ORPHAN", 0), "subchunks": found.get("SUB-CHUNK", 0)}


def _read(spark: SparkSession, path: str, staged: str) -> tuple[DataFrame, DataFrame] | None:
    """Nodes (key, value, parent) and the other collections per file; None if a file isn't a whole store.

    Texts are read and parsed once, into the table ``staged``, of whose columns the checks read few.
    """
    records = _records(spark, path)
    if not records.where("node").take(1):  # no wrapped entries
        raw = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("rest"))
        if raw.where("rest is null").take(1):
            return None
        return _with_parents(_entries(raw, DATA)), raw
    shaped = _parsed(records)
    shaped.write.parquet(staged)
    parsed = spark.read.schema(shaped.schema).parquet(staged)
    bad = parsed.where("node and (not ok or key is null)").take(1) or (rest := _other(parsed)).where("rest is null").take(1)
    if bad or not _keys_agree(parsed):
        return None
    return parsed.where("node").select("key", "value", "parent"), rest


def migrate_docstore(spark: SparkSession, path: str, library: Library, dry_run: bool = False, force: bool = False, backup: bool = False) -> dict:
    """A JSON document store (a file, or a folder of them) into the library's tables ``nodes``, ``ref_docs`` and ``metadata``.

    Gives a status (no_json, already_migrated, corrupted_json, oom, dry_run, write_error, success) and
    the counts of nodes by type and of other entries. ``path`` with ``.bak`` at its end serves if the path isn't
    there; with ``backup`` a migrated store gets that name. A failed write leaves no nodes behind.
    """
    started = time.time()
    stats = dict.fromkeys(("nodes", "parent_nodes", "child_nodes", "subchunks", "ref_doc_entries", "metadata_entries"), 0)

    def told(status: str, **more: object) -> dict:
        return stats | {"status": status, "seconds": round(time.time() - started, 1)} | more

    if not library._exists(path):
        path = f"{path}.bak"
    if not library._exists(path):
        return told("no_json")
    before = library._current("nodes")
    if before and not force and library.count():
        return told("already_migrated")
    at = f"staged-{uuid.uuid4().hex}"
    clear = lambda: Commits(spark, library.root).delete(at)
    try:
        if (found := _read(spark, path, f"{library.root}/{at}")) is None:
            clear()
            return told("corrupted_json")
        nodes, rest = found
        stats |= {"nodes": nodes.count()} | node_counts(nodes)
        stats |= {"ref_doc_entries": _entries(rest, REF_DOC).count(), "metadata_entries": _entries(rest, METADATA).count()}
    except Exception as error:  # noqa: BLE001
        clear()
        return told("oom" if "OutOfMemory" in str(error) else "corrupted_json", error=str(error)[:500])
    if dry_run:
        clear()
        return told("dry_run")
    try:
        for collection, name in _TABLES.items():
            library.keyed(name).overwrite(_entries(rest, collection))
        # the nodes come last: they tell that the store is migrated
        library.keyed("nodes").overwrite(nodes.groupBy("key").agg(F.max("value").alias("value")))
    except Exception as error:  # noqa: BLE001
        return told("write_error", error=str(error)[:500])
    finally:
        clear()
    if backup and not path.endswith(".bak"):
        log = Commits(spark, path.rsplit("/", 1)[0])
        name = path.rsplit("/", 1)[1]
        log._files().rename(log._path(name), log._path(f"{name}.bak"))
    return told("success")
