"""Knowledge bases: a Python data source over a paging fetcher, article clean-up and live search."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import html, text
from ..operators.chunking import recursive_chunks
from ..operators.search import cosine
from ..functions.udfs import arrow_function

ARTICLE = "sys_id string, number string, short_description string, text string, kb_category string, sys_updated_on string"
PAGE_SIZE, LIVE_LIMIT = 100, 10

Fetch = Callable[[str, int, int], list[dict]]


def _plain(value: object) -> str | None:
    """A field that is a string, or a struct with display_value."""
    if isinstance(value, dict):
        value = value.get("display_value") or value.get("value")
    return None if value is None else str(value)


def kb_source(fetch: Fetch) -> type[DataSource]:
    """A source of published articles; one partition per base, pages by offset until one is empty or fails."""

    class Reader(DataSourceReader):
        def __init__(self, bases: list[str]) -> None:
            self.bases = bases

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(b) for b in self.bases] or [InputPartition("")]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            offset = 0
            while partition.value:
                try:
                    rows = fetch(partition.value, offset, PAGE_SIZE)
                except Exception:  # noqa: BLE001  what came so far is kept
                    return
                if not rows:
                    return
                for r in rows:
                    yield tuple(_plain(r.get(c)) for c in ("sys_id", "number", "short_description", "text", "kb_category", "sys_updated_on"))
                offset += PAGE_SIZE

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "knowledge_base"

        def schema(self) -> str:
            return ARTICLE

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Reader([b for b in self.options.get("bases", "").split(",") if b])

    return Source


def articles(spark: SparkSession, fetch: Fetch, bases: str) -> DataFrame:
    spark.dataSource.register(kb_source(fetch))
    return spark.read.format("knowledge_base").option("bases", re.sub(r"[\[\]'\" ]", "", bases)).load()


CHANGES = f"{ARTICLE}, base string, error string, after string, upto string, skip int"
#: Articles of a base that were updated after one time and up to another, by time and id: (base, after, upto, offset, size).
FetchChanges = Callable[[str, str, str, int, int], list[dict]]
TRIES = 3


def _window(fetch: FetchChanges, base: str, after: str, upto: str, skip: int = 0) -> Iterator[tuple]:
    """The articles of a window of update times, page by page; what can't be read ends it with an error row that tells where."""
    none = (None,) * 6
    while True:
        for turn in range(TRIES):
            try:
                rows = fetch(base, after, upto, skip, PAGE_SIZE)
                break
            except Exception as error:  # noqa: BLE001
                if turn == TRIES - 1:
                    yield (*none, base, type(error).__name__, after, upto, skip)
                    return
        if not rows:
            return
        for r in rows:
            yield (*(_plain(r.get(c)) for c in ("sys_id", "number", "short_description", "text", "kb_category", "sys_updated_on")), base, None, after, upto, skip)
        skip += len(rows)


def kb_changes_source(fetch: FetchChanges, newest: Callable[[str], str]) -> type[DataSource]:
    """A stream of articles as they change, and the same for stated windows as a batch.

    The offset is each base's newest update time; a micro-batch has one partition per base that moved,
    the window between two offsets, which gives the same rows whenever it is read. A base whose
    newest time can't be had stays where it was and is asked again at the next trigger.
    """

    class Window(InputPartition):
        def __init__(self, base: str, after: str, upto: str, skip: int = 0) -> None:
            self.base, self.after, self.upto, self.skip = base, after, upto, skip

    class Stream(DataSourceStreamReader):
        def __init__(self, bases: list[str]) -> None:
            self.bases, self.known = bases, {}

        def initialOffset(self) -> dict:  # noqa: N802
            return dict.fromkeys(self.bases, "")

        def latestOffset(self) -> dict:  # noqa: N802
            for base in self.bases:
                try:
                    self.known[base] = max(newest(base) or "", self.known.get(base, ""))
                except Exception:  # noqa: BLE001
                    self.known.setdefault(base, "")
            return dict(self.known)

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [Window(b, start.get(b, ""), upto) for b, upto in sorted(end.items()) if upto > start.get(b, "")]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return _window(fetch, partition.base, partition.after, partition.upto)

    class Batch(DataSourceReader):
        def __init__(self, windows: list[list]) -> None:
            self.windows = windows

        def partitions(self) -> list[InputPartition]:
            return [Window(*w) for w in self.windows]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return _window(fetch, partition.base, partition.after, partition.upto, partition.skip)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "knowledge_base_changes"

        def schema(self) -> str:
            return CHANGES

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
            return Stream([b for b in self.options.get("bases", "").split(",") if b])

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Batch(json.loads(self.options.get("windows", "[]")))

    return Source


def article_changes(spark: SparkSession, fetch: FetchChanges, newest: Callable[[str], str], bases: str) -> DataFrame:
    """A stream of CHANGES: articles, and rows with an error for windows that broke off."""
    spark.dataSource.register(kb_changes_source(fetch, newest))
    return spark.readStream.format("knowledge_base_changes").option("bases", re.sub(r"[\[\]'\" ]", "", bases)).load()


def pulled_again(spark: SparkSession, fetch: FetchChanges, broken: DataFrame) -> DataFrame:
    """What is left of windows that broke off (error rows: one a window, so few), from where they did."""
    windows = [[r.base, r.after, r.upto, r.skip] for r in broken.where("error is not null").select("base", "after", "upto", "skip").distinct().collect()]
    if not windows:
        return spark.createDataFrame([], CHANGES)
    spark.dataSource.register(kb_changes_source(fetch, lambda base: ""))
    return spark.read.format("knowledge_base_changes").option("windows", json.dumps(windows)).load()


def found_live(spark: SparkSession, find: Callable[[str, int], tuple[int, list[dict]]], query: str, limit: int = LIVE_LIMIT) -> DataFrame:
    """At most ``limit`` articles that the service finds for the query's keywords; another status than 200 is an error."""
    words = spark.range(1).select(text.keywords(F.lit(query)).alias("k")).first()[0]
    status, rows = find(words, limit)
    if status != 200:
        raise ConnectionError(f"the knowledge base answered {status}")
    fields = [f.split()[0] for f in ARTICLE.split(", ")]
    return spark.createDataFrame([tuple(_plain(r.get(c)) for c in fields) for r in rows[:limit]], ARTICLE)


def catalogue(spark: SparkSession, fetch: Callable[[int], list[dict]]) -> DataFrame:
    """id and title of active bases, at most 100; an error gives an empty list."""
    try:
        rows = [(_plain(r.get("sys_id")), _plain(r.get("title"))) for r in fetch(PAGE_SIZE)[:PAGE_SIZE]]
    except Exception:  # noqa: BLE001
        rows = []
    return spark.createDataFrame(rows, "id string, title string")


def to_markdown(rows: DataFrame) -> DataFrame:
    """Articles as Markdown documents in a folder per category, with what a sidecar holds."""
    body = F.concat(F.lit("# "), "short_description", F.lit("\n\nReference: "), "number", F.lit("\n\n"), html.to_markdown("text"))
    path = F.concat_ws("/", text.safe_category(F.col("kb_category")), F.concat("number", F.lit(".md")))
    return rows.select(path.alias("path"), body.alias("markdown"), "sys_id", F.col("number").alias("kb_number"), F.col("sys_updated_on").alias("updated_at"))


@arrow_function("array<float>")
def hashed_words(texts: pd.Series) -> pd.Series:
    """Deterministic stand-in of an embedding model: a hashed bag of words of 64 places."""

    def one(t: str | None) -> list[float]:
        v = np.zeros(64, np.float32)
        for w in re.findall(r"\w+", (t or "").lower()):
            v[hashlib.md5(w.encode()).digest()[0] % 64] += 1
        return v.tolist()

    return texts.map(one)


def live_search(found: DataFrame, query: str, top_k: int = 5, embed: Callable[[Column], Column] = hashed_words, limit: int = LIVE_LIMIT) -> DataFrame:
    """number, title, chunk, score: the best chunks of at most ``limit`` articles (number, title, html) that have a keyword."""
    spark = found.sparkSession
    words = spark.range(1).select(text.keywords(F.lit(query)).alias("k")).first()[0].lower().split()
    hits = F.aggregate(F.array(*[F.contains(F.lower("html"), F.lit(w)).cast("int") for w in words] or [F.lit(0)]), F.lit(0), lambda a, x: a + x)
    top = found.withColumn("_hits", hits).where("_hits > 0").orderBy(F.desc("_hits"), "number").limit(limit)

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(recursive_chunks)

    chunks = top.select("number", "title", F.posexplode(split(html.kb_text("html"))).alias("pos", "chunk"))
    shown = F.concat(F.lit("Title: "), "title", F.lit("\nKB: "), "number", F.lit("\nContent: "), "chunk")
    scored = chunks.withColumn("score", F.round(cosine(embed(shown), embed(F.lit(query))), 6))
    return scored.orderBy(F.desc("score"), "number", "pos").limit(top_k)
