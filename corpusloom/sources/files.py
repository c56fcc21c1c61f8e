"""File scans: sources, Markdown, sidecars, page metadata, and what is missing between two trees."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators.filters import CRAWL_FILES, SOURCE_TYPES, pdf_reject_reason


def _named(files: DataFrame, root: str) -> DataFrame:
    """path relative to root, name, ext, stem; backslashes become slashes."""
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    path = F.regexp_replace(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "^[a-z]+:/*", "/")
    rel = F.when(F.startswith(path, base), F.substr(path, F.length(base) + 2)).otherwise(path)
    rows = files.withColumn("path", rel).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return rows.withColumn("ext", text.file_type(F.col("name"))).withColumn("stem", urls.stem(F.col("name")))


def scan_sources(spark: SparkSession, root: str, types: tuple[str, ...] = SOURCE_TYPES, content: bool = False) -> DataFrame:
    """path, name, ext, stem, length, modified of source files below root, without what a crawl leaves beside them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    own = files.select("path", F.col("modificationTime").alias("modified"), "length", *(["content"] if content else []))
    rows = _named(own, root)
    return rows.where(F.col("ext").isin(*types) & ~F.lower("name").isin(*CRAWL_FILES))


def require_files(files: DataFrame) -> DataFrame:
    """The files, or an error when an upload has none that is usable."""
    if files.isEmpty():
        raise ValueError("no usable file")
    return files


def validated(files: DataFrame) -> DataFrame:
    """files with content: reject_reason for what isn't the PDF that its name says."""
    return files.withColumn("reject_reason", F.when(F.col("ext") == "pdf", pdf_reject_reason(F.col("content"))))


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """path, name, text of Markdown files, without sidecars."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root)
    return _named(rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), root).select("path", "name", "text")


def scan_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """path of the Markdown file, name, source_url, source_filename, source_relative_path."""
    schema = "source_url string, source_filename string, source_relative_path string, _file string"
    rows = spark.read.schema(schema.replace(", _file string", "")).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md.meta").json(root)
    rows = _named(rows.withColumn("path", F.col("_metadata.file_path")), root)
    bare = lambda c: F.regexp_replace(c, r"\.meta$", "")
    return rows.select(bare(F.col("path")).alias("path"), bare(F.col("name")).alias("name"), "source_url", "source_filename", "source_relative_path")


def with_sidecars(documents: DataFrame, sidecars: DataFrame) -> DataFrame:
    """By path, else the first of the same name anywhere."""
    fields = ("source_url", "source_filename", "source_relative_path")
    direct = sidecars.select("path", F.struct(*fields).alias("_direct"))
    first = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    named = sidecars.withColumn("r", first).where("r = 1").select("name", F.struct(*fields).alias("_named"))
    rows = documents.join(direct, "path", "left").join(named, "name", "left").withColumn("_meta", F.coalesce("_direct", "_named"))
    return rows.select(*documents.columns, *[F.col(f"_meta.{f}").alias(f) for f in fields])


PAGE = (
    "url string, contentHash string, crawledAt timestamp, title string, depth int, referrer string, htmlFile string, status int, "
    "downloadedDocuments array<struct<fileName:string,originalUrl:string,linkText:string>>, htmlLinks array<struct<url:string,text:string>>"
)


def scan_page_metadata(spark: SparkSession, root: str) -> DataFrame:
    """One row per url from all metadata.json; the last file by path wins."""
    rows = spark.read.schema(PAGE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").json(root).withColumn("file", F.col("_metadata.file_path"))
    last = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("file")))
    return rows.withColumn("r", last).where("r = 1").drop("r")


def missing_conversions(sources: DataFrame, markdown: DataFrame) -> DataFrame:
    """Sources without a Markdown file at the mirrored path."""
    key = lambda c: F.lower(F.regexp_replace(c, r"\.[^./]*$", ""))
    return sources.withColumn("_key", key(F.col("path"))).join(markdown.select(key(F.col("path")).alias("_key")), "_key", "left_anti").drop("_key")


def converted(files: DataFrame, convert: Callable[[bytes, str], str], done: DataFrame | None = None, least: int = 10) -> DataFrame:
    """path, markdown, outcome: each file once whatever its case, those done are left out, short results are rejected."""
    once = files.dropDuplicates(["path"]).withColumn("_low", F.lower("path"))
    once = once.withColumn("r", F.row_number().over(Window.partitionBy("_low").orderBy("path"))).where("r = 1")
    if done is not None:
        once = once.join(done.select("path"), "path", "left_anti")

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = []
            for path, ext, content in batch[["path", "ext", "content"]].itertuples(index=False):
                try:
                    out = convert(content, ext)
                    rows.append((path, out, "converted" if len(out.strip()) >= least else "too short"))
                except Exception as error:  # noqa: BLE001  a file that fails doesn't end the others
                    rows.append((path, None, f"failed: {type(error).__name__}"))
            yield pd.DataFrame(rows, columns=["path", "markdown", "outcome"])

    found = once.select("path", "ext", "content").mapInPandas(run, "path string, markdown string, outcome string")
    return found.withColumn("markdown", text.repair_mojibake(F.col("markdown")))


def served(files: DataFrame, path: str) -> DataFrame:
    """The file at a path, else any of its stem, with its MIME type; paths that leave the tree find nothing."""
    if ".." in path.split("/") or path.startswith("/"):
        return files.limit(0).withColumn("mime", F.lit(None).cast("string"))
    wanted = path.rsplit("/", 1)[-1]
    stem = wanted.rsplit(".", 1)[0] if "." in wanted.lstrip(".") else wanted
    rank = F.when(F.col("path") == path, 0).when(F.col("stem") == stem, 1)
    hit = files.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "path").limit(1)
    return hit.drop("_rank").withColumn("mime", urls.mime_type(F.col("name")))
