"""Row predicates and validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pdf import pdf_problem

# Words of tables of contents in four languages.
TOC_WORDS = ("table des matières", "table of contents", "sommaire", "inhaltsverzeichnis", "indice", "contents", "chapitre", "chapter", "kapitel")
SOURCE_TYPES = ("pdf", "docx", "html", "htm", "pptx", "xlsx")
CRAWL_FILES = ("metadata.json", "page.html")


def _share(c: Column, char: str) -> Column:
    return F.coalesce(F.try_divide(F.length(c) - F.length(F.replace(c, F.lit(char), F.lit(""))), F.length(c)), F.lit(0.0))


def maybe_toc(c: Column, dots: float = 0.08, spaces: float = 0.30, size: int = 15_000) -> Column:
    """Worth a classifier's look: a table, many dots or blanks, huge, or with a contents word."""
    words = F.exists(F.array(*[F.lit(w) for w in TOC_WORDS]), lambda w: F.contains(F.lower(c), w))
    return F.contains(c, F.lit("|")) | (_share(c, ".") > dots) | (_share(c, " ") > spaces) | (F.length(c) > size) | words


def without_toc(nodes: DataFrame, classify: Callable[[Column], Column] | None = None) -> DataFrame:
    """Nodes that the classifier, asked about suspects only, doesn't call a table of contents; its failures (null) keep a node."""
    if classify is None:
        return nodes
    verdict = F.when(maybe_toc(F.col("text")), classify(F.col("text")))
    return nodes.withColumn("_toc", F.coalesce(verdict, F.lit(False))).where(~F.col("_toc")).drop("_toc")


def not_empty(c: Column, min_length: int, min_lines: int) -> Column:
    return (F.length(c) > min_length) & (F.size(F.split(c, "\n")) >= min_lines)


def table_like(c: Column) -> Column:
    return c.rlike(r"\||-{4,}|\.{5,}|_{4,}")


def without_marks(line: Column, *marks: str) -> Column:
    """Lines of a log that have none of the marks in them."""
    return ~F.exists(F.array(*[F.lit(m) for m in marks]).cast("array<string>"), lambda m: F.contains(line, m))


def in_folder(path: Column, *names: str) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def pdf_reject_reason(content: Column) -> Column:
    """Null for a PDF that can be opened, has pages and a first page that can be read; rejected rows are marked, never deleted."""
    signature = F.coalesce(F.substring(content, 1, 5) == F.encode(F.lit("%PDF-"), "UTF-8"), F.lit(False))
    return F.when(~signature, "invalid_pdf_signature").otherwise(pdf_problem(content))


def rejected_header(content: Column) -> Column:
    """What a file begins with instead of a signature: up to five bytes, as far as they are text."""
    return F.make_valid_utf8(F.decode(F.substring(content, 1, 5), "ISO-8859-1"))


def file_outcomes(files: DataFrame, converted: DataFrame) -> DataFrame:
    """files (pos, path, ext, stem) with outcome: rejected, converted before, duplicate, accepted."""
    rows = files.join(converted.select("path", F.lit(True).alias("_done")), "path", "left")
    first = F.row_number().over(Window.partitionBy("stem", F.col("_done").isNotNull(), F.lower("ext") == "doc").orderBy("pos"))
    outcome = F.when(F.lower("ext") == "doc", "rejected").when(F.col("_done").isNotNull(), "converted").when((first > 1) & (F.col("stem") != "metadata"), "duplicate").otherwise("accepted")
    return rows.withColumn("outcome", outcome).drop("_done")
