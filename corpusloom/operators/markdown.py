"""Markdown operators on whole texts, line by line; in the JVM but for the cut at headers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..functions.udfs import arrow_function

_HEADER = re.compile(r"(#+)\s(.*)", re.DOTALL)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def is_flat(c: Column) -> Column:
    """Headers of level 2 only."""
    has = lambda p: F.exists(F.transform(_lines(c), _strip), lambda x: x.rlike(p))
    return has(r"^##(?!#)") & ~has(r"^#(?!#)") & ~has(r"^###")


def hierarchy_restored(c: Column) -> Column:
    """Sections become level 1 and articles level 3; chapters and titles stay level 2."""

    def one(line: Column) -> Column:
        title = F.regexp_extract(_strip(line), r"^## (.*)$", 1)
        return (
            F.when(title.rlike(r"(?iU)^SECTION\s"), F.concat(F.lit("# "), title))
            .when(title.rlike(r"(?iU)^(CHAPITRE|TITRE)\s"), F.concat(F.lit("## "), title))
            .when(title.rlike(r"(?iU)^Art(icle)?\.?\s+\d+"), F.concat(F.lit("### "), title))
            .otherwise(line)
        )

    return F.array_join(F.transform(_lines(c), one), "\n")


def repaired(c: Column) -> Column:
    return F.when(is_flat(c), hierarchy_restored(c)).otherwise(c)


_EDGE = re.compile(r"^[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+|[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+\Z")


def once(text: Column, mark: str = "#") -> Column:
    """The text without header lines that stood before; any line counts as a header when mark is empty."""

    def kept(lines: list[str]) -> Iterator[str]:
        met: set[str] = set()
        for line in lines:
            key = _EDGE.sub("", line)
            if not key.startswith(mark) or key not in met:
                yield line
            met.add(key)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "\n".join(kept(t.split("\n"))))

    return cut(text)


def first_of_repeated(docs: DataFrame, mark: str = "#") -> DataFrame:
    """doc_id, text of documents that have a text, without header lines that stood before; nothing is shuffled."""
    return docs.where("text is not null").select("doc_id", once(F.col("text"), mark).alias("text"))


def whitespace_cleaned(c: Column) -> Column:
    """Embedded images go; table, rule and other lines lose what only aligns them; at most two empty lines in a row."""
    bare = F.regexp_replace(c, r"!\[[^\]]*\]\(data:image/[^;]+;base64,[A-Za-z0-9+/=]+\)", "")

    def one(line: Column) -> Column:
        s = _strip(line)
        pipes = F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit("")))
        table = F.contains(line, F.lit("|"))
        cells = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.greatest(pipes - 1, F.lit(0))), " | "), F.lit(" |"))
        rule = lambda ch, to: (F.contains(line, F.lit(ch)), F.lit(to))
        rules = F.lit(None).cast("string")
        for test, to in reversed([rule("-", "---"), rule("_", "___"), rule("=", "==="), rule(".", "...")]):
            rules = F.when(test, to).otherwise(rules)
        return (
            F.when(table & s.rlike(r"(?U)^[\s|\-_=:]+$"), F.when(pipes >= 2, cells).otherwise(s))
            .when(table, collapse(F.regexp_replace(line, r"(?U)\s*\|\s*", " | ")))
            .when(s.rlike(r"(?U)^[\s\-_=.]+$"), F.coalesce(rules, s))
            .otherwise(F.regexp_replace(line, r"(?U)\s{3,}", "  "))
        )

    return F.regexp_replace(F.array_join(F.transform(_lines(bare), one), "\n"), r"\n{4,}", "\n\n\n")


def reduction(before: Column, after: Column) -> Column:
    """Per cent of characters saved; 0 for an empty text."""
    return F.coalesce(F.try_divide((F.length(before) - F.length(after)) * 100.0, F.length(before)), F.lit(0.0))


def size_totals(rows: DataFrame) -> DataFrame:
    """before_chars, after_chars and reduction in per cent of rows (before, after)."""
    sums = rows.agg(F.sum(F.length("before")).alias("before_chars"), F.sum(F.length("after")).alias("after_chars"))
    return sums.withColumn("reduction", F.round((F.col("before_chars") - F.col("after_chars")) * 100.0 / F.col("before_chars"), 4))


@arrow_function("array<struct<level:int,title:string,header_path:string,text:string>>")
def _cut_at_headers(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[dict]:
        if text is None:
            return []
        found: list[tuple[int, str, list[str]]] = [(0, "", [])]
        fenced = False
        for line in text.split("\n"):
            if line.lstrip(" ").startswith("```"):
                fenced = not fenced
            elif not fenced and (head := _HEADER.match(line)):
                found.append((len(head[1]), head[2].strip(), []))
            found[-1][2].append(line)
        rows, open_ = [], []
        for level, title, lines in found:
            # a header ends all open ones of its level or below
            while open_ and open_[-1][0] >= level:
                open_.pop()
            path = f"/{'/'.join(t for _, t in open_)}/" if open_ else "/"
            if level:
                open_.append((level, title))
            if body := "\n".join(lines).strip():
                rows.append({"level": level, "title": title, "header_path": path, "text": body})
        return rows

    return texts.map(one)


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, ord, level, title, header_path, text of every section between headers outside code fences, plus other columns of docs.

    header_path names the ancestors between slashes, or is / alone. Blank sections are left out. A text
    is cut where it is, so nothing is shuffled.
    """
    kept = [c for c in docs.columns if c not in ("doc_id", "text", "ord", "level", "title", "header_path")]
    cut = docs.select("doc_id", *kept, F.posexplode(_cut_at_headers("text")).alias("ord", "_s"))
    return cut.select("doc_id", "ord", *[F.col(f"_s.{c}") for c in ("level", "title", "header_path", "text")], *kept)
