"""The crawl's frontier as keyed state of a stream.

Events (host, url, kind, seq, at, referrer, depth) come in any number of micro-batches: a link was
found, or a page was visited or failed. State holds every URL once, as queued, visited or failed. A
link queues its URL unless that is queued or visited already; what is queued goes to the output
stream, to be taken in the order of ``seq``, first in, first out. A failed URL is queued again by
the next link to it, or, with ``retry``, by a timer when the watermark has passed its time plus
the delay, doubled with each failure, up to ``attempts`` in all. The checkpoint holds the state, so a
crawl that is stopped goes on where it was.

Within a micro-batch events apply in the order of ``seq``. State is keyed by host and one of
``slots`` parts of its URLs, so a host that has most pages is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENT = "host string, url string, kind string, seq long, at timestamp, referrer string, depth int"
QUEUED = "host string, url string, attempt int, seq long, referrer string, depth int"
SLOTS, ATTEMPTS = 16, 3
_URL = "url string"
_STATE = "status string, failures int, seq long, referrer string, depth int"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Frontier(StatefulProcessor):
    """State of the URLs of one part of a host: (status, failures, seq, referrer, depth) by URL."""

    def __init__(self, retry: timedelta | None, attempts: int) -> None:
        self.retry, self.attempts = retry and int(retry.total_seconds() * 1000), attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.urls = handle.getMapState("urls", _URL, _STATE)
        self.due = handle.getMapState("due", _URL, "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        events = pd.concat([r[["url", "kind", "seq", "at", "referrer", "depth"]] for r in rows]).sort_values("seq", kind="stable")
        out = []
        for url, own in events.groupby("url", sort=False):
            held = self.urls.getValue((url,))
            status, failures, seq, referrer, depth = held or (None, 0, None, None, None)
            had = due = self.due.getValue((url,)) if self.retry and held else None
            for kind, at_seq, at, page, level in own[["kind", "seq", "at", "referrer", "depth"]].itertuples(index=False):
                if kind == "link" and status not in ("queued", "visited"):
                    status, seq, referrer, depth = "queued", int(at_seq), page, None if pd.isna(level) else int(level)
                    out.append((key[0], url, failures + 1, seq, referrer, depth))
                elif kind == "visited":
                    status, due = "visited", None
                elif kind == "failed" and status != "visited":
                    status, failures = "failed", failures + 1
                    seq = int(at_seq) if seq is None else seq
                    again = self.retry and failures < self.attempts
                    due = int(at.timestamp() * 1000) + (self.retry << (failures - 1)) if again else None
            if due != had and due is not None:
                self.due.updateValue((url,), (due,))
                self.handle.registerTimer(due)
            elif due is None and had:
                self.due.removeKey((url,))
            if (status, failures, seq, referrer, depth) != held:
                self.urls.updateValue((url,), (status, failures, seq, referrer, depth))
        yield pd.DataFrame(out, columns=["host", "url", "attempt", "seq", "referrer", "depth"]).astype({"depth": "Int32", "attempt": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (url,), (time,) in list(self.due.iterator()):
            if time <= now:
                self.due.removeKey((url,))
                status, failures, seq, referrer, depth = self.urls.getValue((url,))
                if status == "failed":
                    self.urls.updateValue((url,), ("queued", failures, seq, referrer, depth))
                    out.append((key[0], url, failures + 1, seq, referrer, depth))
        yield pd.DataFrame(out, columns=["host", "url", "attempt", "seq", "referrer", "depth"]).astype({"depth": "Int32", "attempt": "int32"})

    def close(self) -> None:
        pass


def frontier(events: DataFrame, retry: timedelta | None = None, attempts: int = ATTEMPTS, slots: int = SLOTS, delay: str = "0 seconds") -> DataFrame:
    """What is queued, as it is queued: host, url, attempt (from 1), seq, referrer, depth."""
    rows = events.withColumn("slot", F.pmod(F.xxhash64("url"), F.lit(slots)))
    if retry:
        rows = rows.withWatermark("at", delay)
    return rows.groupBy("host", "slot").transformWithStateInPandas(Frontier(retry, attempts), QUEUED, "Append", "EventTime" if retry else "None")


def crawled(queued: DataFrame, out: str, checkpoint: str, available_now: bool = True):  # noqa: ANN201
    """Writes the frontier's stream to Parquet; a micro-batch that is run again replaces its own folder."""
    spark = queued.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = queued.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # state of this kind is kept by this provider only; a query takes it over when it starts
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(_PROVIDER, before)
