"""The crawl's frontier in state, against the rules applied one by one."""

import random
from datetime import datetime, timedelta

from corpusloom.streaming import frontier as F


def plain(events):
    """Rows that are queued when the events are applied in order."""
    status, failures, out = {}, {}, []
    for host, url, kind, seq, _, referrer, depth in sorted(events, key=lambda e: e[3]):
        if kind == "link" and status.get(url) not in ("queued", "visited"):
            status[url] = "queued"
            out.append((host, url, failures.get(url, 0) + 1, seq, referrer, depth))
        elif kind == "visited":
            status[url] = "visited"
        elif kind == "failed" and status.get(url) != "visited":
            status[url], failures[url] = "failed", failures.get(url, 0) + 1
    return sorted(out)


def run(spark, path, batches, retry=None):
    """Each batch of events in a run of its own, which begins from the checkpoint."""
    for events in batches:
        spark.createDataFrame(events, F.EVENT).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(F.EVENT).parquet(f"{path}/in")
        F.crawled(F.frontier(stream, retry, slots=2), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return sorted(tuple(r)[:6] for r in spark.read.parquet(f"{path}/out").select("host", "url", "attempt", "seq", "referrer", "depth").collect())


def test_restarts_give_the_same_queue(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    events = []
    for seq in range(400):
        host = rng.choice("aab")
        kind = rng.choices(("link", "visited", "failed"), (6, 1, 2))[0]
        depth = rng.choice((None, 1, 2))
        events.append((host, f"http://{host}/{rng.randrange(30)}", kind, seq, start + timedelta(seconds=seq), None if depth is None else f"r{seq}", depth))
    want = plain(events)
    assert any(r[2] > 1 for r in want)
    mixed = [events[:150], events[150:250], events[250:]]
    for part in mixed:
        rng.shuffle(part)
    assert run(spark, tmp_path, mixed) == want


def test_timers_queue_failures_again(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda minutes: start + timedelta(minutes=minutes)
    link = lambda url, seq, minutes: ("h", url, "link", seq, at(minutes), "r", 1)
    fail = lambda url, seq, minutes: ("h", url, "failed", seq, at(minutes), None, None)
    batches = [
        [link("a", 1, 0), link("b", 2, 0), fail("a", 3, 1), fail("b", 4, 1), ("h", "b", "visited", 5, at(2), None, None)],
        [link("clock", 6, 20)],  # moves the watermark past the first delay
        [fail("a", 7, 21), link("clock", 8, 30)],
        [link("clock", 9, 60)],  # the second delay is twice as long
        [fail("a", 10, 61), link("clock", 11, 200)],  # no more attempts
        [link("clock", 12, 300)],
    ]
    got = run(spark, tmp_path, batches, timedelta(minutes=10))
    assert [r for r in got if r[1] == "a"] == [("h", "a", 1, 1, "r", 1), ("h", "a", 2, 1, "r", 1), ("h", "a", 3, 1, "r", 1)]
    assert [r[:3] for r in got if r[1] == "b"] == [("h", "b", 1)] and [r[2] for r in got if r[1] == "clock"] == [1]
