"""Results of search requests, kept in the driver's memory and in a table of the library.

The table is a log: a write adds a small file to the open part, and readers take the newest entry of
a key from all parts. Now and then the log is compacted to the entries last used. A commit first
closes the open part and opens another one; then the closed parts are read and a second commit puts
the result in their place. A writer that finds its part closed after its write repeats it in the
open one, so of writers at the same time, on any drivers, none loses an entry.
"""

from __future__ import annotations

import time
import uuid
from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.diagnostics import cache_kept
from .store import Library

ENTRY = "key string, rows array<struct<child_id:string,context_id:string,score:double>>, last_used double"
MOST, FILES = 10_000, 64


class ResultCache:
    """Rows (child_id, context_id, score) by key: the ``most`` last used in each tier, scores at two decimals.

    A hit in the table moves the entry to memory. Writes replace an entry in both tiers. The table keeps
    more than ``most`` entries until ``files`` writes bring the next compaction.
    """

    def __init__(self, library: Library, most: int = MOST, files: int = FILES) -> None:
        self.library, self.most, self.files = library, most, files
        self.log = library.commits("cache")
        self.held: OrderedDict[str, list[tuple]] = OrderedDict()
        self.counts = dict.fromkeys(("ram_hits", "disk_hits", "misses", "writes"), 0)

    def _hold(self, key: str, rows: list[tuple]) -> None:
        self.held[key] = rows
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)

    def _open(self) -> tuple[int, dict]:
        """The last commit, which has an open part."""
        number, state = self.log.latest()
        while not state:
            self.log.commit(0, {"closed": [], "open": uuid.uuid4().hex})
            number, state = self.log.latest()
        return number, state

    def _entries(self, parts: list[str]) -> DataFrame:
        spark, own = self.library.spark, [f"{self.log.root}/data/{p}" for p in parts if self.log.names(f"data/{p}")]
        return spark.read.schema(ENTRY).option("recursiveFileLookup", True).parquet(*own) if own else spark.createDataFrame([], ENTRY)

    def _newest(self, parts: list[str]) -> DataFrame:
        last = F.max_by(F.struct("rows", "last_used"), "last_used").alias("e")
        return self._entries(parts).groupBy("key").agg(last).select("key", "e.*")

    def entries(self) -> DataFrame:
        """The entries of the table that the next compaction will keep."""
        state = self._open()[1]
        return cache_kept(self._newest([*state["closed"], state["open"]]), self.most)

    def get(self, key: str) -> list[tuple] | None:
        if key in self.held:
            self.counts["ram_hits"] += 1
            self.held.move_to_end(key)
            return self.held[key]
        state = self._open()[1]
        row = self._entries([*state["closed"], state["open"]]).where(F.col("key") == key).orderBy(F.desc("last_used")).select("rows").first()
        self.counts["misses" if row is None else "disk_hits"] += 1
        if row is None:
            return None
        rows = [tuple(r) for r in row[0]]
        self._hold(key, rows)
        return rows

    def lookup(self, requests: DataFrame) -> DataFrame:
        """requests (key, ..) with hit and rows of the table, in one join."""
        state = self._open()[1]
        found = self._newest([*state["closed"], state["open"]]).select("key", "rows", F.lit(True).alias("hit"))
        return requests.join(found, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def put(self, key: str, rows: list[tuple]) -> None:
        rounded = [(child, context, None if score is None else round(score, 2)) for child, context, score in rows]
        self._hold(key, rounded)
        new = self.library.spark.createDataFrame([(key, rounded, time.time())], ENTRY)
        self._append(new.coalesce(1))
        self.counts["writes"] += 1

    def put_all(self, entries: DataFrame) -> None:
        """Entries (key, rows, last_used) into the table, many at once."""
        rounded = F.transform("rows", lambda r: r.withField("score", F.round(r["score"], 2)))
        self._append(entries.select("key", rounded.alias("rows"), "last_used"))

    def _append(self, new: DataFrame) -> None:
        while True:
            part = self._open()[1]["open"]
            new.write.parquet(f"{self.log.root}/data/{part}/{uuid.uuid4().hex}")
            if self._open()[1]["open"] == part:
                break  # a compaction that comes now will read it
        if len(self.log.names(f"data/{part}")) >= self.files:
            self.compact()

    def compact(self) -> bool:
        """Keeps the ``most`` entries last used; False if another driver was at it."""
        number, state = self._open()
        state = {"closed": [*state["closed"], state["open"]], "open": uuid.uuid4().hex}
        if not self.log.commit(number, state):
            return False
        kept = uuid.uuid4().hex
        cache_kept(self._newest(state["closed"]), self.most).write.parquet(f"{self.log.root}/data/{kept}")
        done = self.log.commit(number + 1, state | {"closed": [kept]})
        for part in state["closed"] if done else [kept]:
            self.log.delete(f"data/{part}")
        return done

    def clear(self) -> None:
        """Both tiers."""
        self.held.clear()
        number, state = self._open()
        while not self.log.commit(number, {"closed": [], "open": uuid.uuid4().hex}):
            number, state = self._open()
        for part in (*state["closed"], state["open"]):
            self.log.delete(f"data/{part}")

    def stats(self) -> dict:
        """The counts and the hit rate in per cent."""
        hits = self.counts["ram_hits"] + self.counts["disk_hits"]
        asked = hits + self.counts["misses"]
        return self.counts | {"hit_rate": round(100.0 * hits / asked, 2) if asked else 0.0}
