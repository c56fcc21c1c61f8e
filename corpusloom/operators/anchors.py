"""Source anchors: pages and text fragments that nodes come from, by fuzzy matching."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fuzzy import grams, may_reach, partial_ratio

SNIPPET, SHORT, ACCEPT, SURE, WIDEN = 300, 50, 50, 95, 90


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by document in a fixed number of tasks: comparing texts takes far longer than their size tells."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def _contained(a: str, b: str | None) -> bool:
    """Whether the shorter one is part of the longer: what a partial ratio of 100 means."""
    return bool(a and b) and (a in b if len(a) <= len(b) else b in a)


def _ratios() -> Callable[[str, str | None, float], float]:
    """``partial_ratio``, of which the grams rule out most pairs that can't reach the cutoff; grams of a text are made once."""
    made: dict[str, frozenset[str]] = {}

    def own(text: str) -> frozenset[str]:
        if text not in made:
            made[text] = grams(text)
        return made[text]

    def score(a: str, b: str | None, cutoff: float) -> float:
        if a and b:
            short, long = sorted((a, b), key=len)
            if not may_reach(len(short), own(short), own(long), cutoff):
                return 0.0
        return partial_ratio(a, b, cutoff)

    return score


def page_locations(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """node_id, page_number (from 1), page_confidence of nodes (doc_id, node_id, ord, text) on pages (doc_id, page, text).

    The place found for a node is where the next one is looked for first: the same page, up to four
    earlier ones, and all others if the best of these is poor. One document's nodes and pages meet
    in one Python call. The first page that contains the node ends any search, so pages before it are
    compared only as far as they could end it earlier.
    """
    snippet = F.substring(T.normalize_for_comparison(F.col("text")), 1, SNIPPET)
    a = nodes.select("doc_id", "node_id", "ord", snippet.alias("body"))
    b = pages.select("doc_id", F.col("page").cast("long").alias("page"), T.normalize_for_comparison(F.col("text")).alias("body"))

    def locate(key: tuple, own: pd.DataFrame, sheets: pd.DataFrame) -> pd.DataFrame:
        bodies = dict(zip(sheets["page"], sheets["body"]))
        rows, last = [], min(bodies, default=0)
        order, ratio = sorted(bodies), _ratios()
        for node_id, body in own.sort_values("ord")[["node_id", "body"]].itertuples(index=False):
            if body is None or len(body) < SHORT or not bodies:
                continue
            best, score = last, 0.0

            def visit(numbers: Iterable[int], cutoff: float, body: str = body) -> None:
                nonlocal best, score
                for n in numbers:
                    if (s := 100.0 if _contained(body, bodies[n]) else ratio(body, bodies[n], max(score, cutoff))) > score:
                        best, score = n, s
                        if s > SURE:
                            return

            near = [last, *(last - k for k in range(1, 5) if last - k > 0 and last - k in bodies)]
            others = lambda near=near: (n for n in order if n not in near)
            if any(_contained(body, bodies[n]) for n in near):
                visit(near, SURE)
            elif any(_contained(body, bodies[n]) for n in others()):
                visit(near, WIDEN)
                if score < WIDEN:
                    visit(others(), SURE)
            else:
                visit(near, ACCEPT)
                if score < WIDEN:
                    visit(others(), ACCEPT)
            if score >= ACCEPT:
                rows.append((node_id, int(best) + 1, score))
                last = best
        return pd.DataFrame(rows, columns=["node_id", "page_number", "page_confidence"])

    return _dealt(a).groupBy("doc_id").cogroup(_dealt(b).groupBy("doc_id")).applyInPandas(locate, "node_id string, page_number long, page_confidence double")


def fragment_locations(nodes: DataFrame, elements: DataFrame, threshold: int = 90) -> DataFrame:
    """node_id, search_text_start, search_text_end, anchor_type from elements (doc_id, pos, tag, text, visible, title).

    One document's nodes and elements meet in one Python call. An element that contains the node, or is
    part of it, has the highest score there is; others of its kind are compared only without one.
    """
    body = T.normalize_for_comparison(F.col("text"))
    a = nodes.select("doc_id", "node_id", body.alias("body"))
    usable = F.coalesce((F.length("text") >= 30) & (F.length("body") >= 20), F.lit(False))
    b = elements.where("doc_id is not null").withColumn("body", body).select("doc_id", "pos", F.when(usable, F.col("text")).alias("text"), F.when(usable, F.col("body")).alias("body"), "visible", T.is_clean(F.col("text")).alias("clean"), "title")

    def locate(key: tuple, own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        has, ratio = bool(len(parts)), _ratios()
        kinds: dict[tuple[bool, bool], list[tuple]] = {}
        for text, words, visible, clean, title, pos in parts[["text", "body", "visible", "clean", "title", "pos"]].itertuples(index=False):
            if text is not None and visible is not None:
                kinds.setdefault((bool(visible), bool(clean)), []).append((text, words, title, pos))

        def found(node: str | None, visible: bool, clean: bool) -> tuple | None:
            """The element of a kind that is most like the node, of equal ones the longest, the first."""
            mine = kinds.get((visible, clean), [])
            whole = [(-100.0, -len(e[0]), e[3], e) for e in mine if _contained(e[1], node)]
            least = float(threshold)
            for e in mine if not whole else ():
                if (s := ratio(e[1], node, least)) >= least:
                    whole.append((-s, -len(e[0]), e[3], e))
                    least = s
            return min(whole, key=lambda x: x[:3])[3] if whole else None

        rows = []
        for node_id, node in own[["node_id", "body"]].itertuples(index=False):
            first, third = found(node, True, True), None
            second = first or found(node, True, False)
            if first is None or not all(T.fragments(first[0])):  # else its fragments are the result
                third = found(node, False, True) or found(node, False, False)
            rows.append((node_id, None if node is None else len(node), has, first and first[0], second and second[0], third and third[2]))
        return pd.DataFrame(rows, columns=["node_id", "size", "has", "t1", "t2", "t3"], dtype=object)

    best = _dealt(a).groupBy("doc_id").cogroup(_dealt(b).groupBy("doc_id")).applyInPandas(locate, "node_id string, size int, has boolean, t1 string, t2 string, t3 string")
    f1, f2 = T.start_end_fragments(F.col("t1")), T.start_end_fragments(T.longest_clean(F.col("t2")))
    clean_title = F.when(T.is_clean(F.col("t3")), T.start_end_fragments(F.col("t3")))
    plain = T.punctuation_spacing(F.col("t3"))
    found = best.select("node_id", "size", "has", f1.alias("f1"), f2.alias("f2"), clean_title.alias("f3"), plain.alias("plain"))
    chosen = F.when(F.col("f1.start").isNotNull() & F.col("f1.end").isNotNull(), F.col("f1")).when(F.col("f2.start").isNotNull() & F.col("f2.end").isNotNull(), F.col("f2"))
    chosen = chosen.when(F.col("f3.start").isNotNull() & F.col("f3.end").isNotNull(), F.col("f3")).otherwise(F.struct(F.col("plain").alias("start"), F.col("plain").alias("end")))
    placed = found.withColumn("f", chosen).select("node_id", "size", "has", F.col("f.start").alias("search_text_start"), F.col("f.end").alias("search_text_end"))
    kind = F.when(F.col("size") < 20, "too_short").when(F.col("search_text_start").isNotNull(), "text_fragment").when(~F.col("has"), "no_text_elements").otherwise("no_match")
    return placed.select("node_id", "search_text_start", "search_text_end", kind.alias("anchor_type"))


def anchored(nodes: DataFrame, fragments: DataFrame, pages: DataFrame) -> DataFrame:
    """nodes (node_id, ext, parent_id) with their anchor's kind: pages for pdf, fragments for html; parents are skipped."""
    rows = nodes.join(fragments.select("node_id", "anchor_type"), "node_id", "left").join(pages.select("node_id", "page_number"), "node_id", "left")
    kind = (
        F.when(F.col("parent_id").isNull(), "skipped parent")
        .when(F.col("ext").isin("html", "htm"), F.coalesce("anchor_type", F.lit("failed")))
        .when(F.col("ext") == "pdf", F.when(F.col("page_number").isNotNull(), "page").otherwise("failed"))
        .otherwise("unsupported")
    )
    return rows.withColumn("anchor", kind)


def without_anchor(nodes: DataFrame) -> DataFrame:
    """Children that have neither fragment nor page."""
    return nodes.where("parent_id is not null and search_text_start is null and page_number is null")
