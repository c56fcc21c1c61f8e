"""Remote calls with planted failures."""

import threading
import time

from pyspark.sql import functions as F

from corpusloom.functions import remote
from corpusloom.operators import filters


def flaky(payloads):
    """Fails for what holds "bad"; fails the first time for what holds "once"; hangs for "slow"."""
    known = flaky.__dict__.setdefault("known", set())
    for p in payloads:
        if "bad" in p:
            raise RuntimeError(p)
        if "slow" in p:
            time.sleep(3)
        if "once" in p and p not in known:
            known.add(p)
            raise ConnectionError(p)
    return [len(p) for p in payloads]


def test_rows_stay_in_order(spark):
    texts = [f"text {k}" + (" bad" if k % 17 == 0 else " once" if k % 5 == 0 else "") for k in range(300)] + [None, ""]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string").repartition(3)
    asked = remote.remote(flaky, "int", size=7, concurrency=4, wait=0.0)
    got = rows.withColumn("asked", asked(F.col("text"))).collect()
    assert {r.id for r in got} == set(range(302))
    for r in got:
        want = (None, None) if r.text is None else (None, "RuntimeError") if "bad" in r.text else (len(r.text), None)
        assert tuple(r.asked) == want


def test_timeouts_and_wrong_answers(spark):
    rows = spark.createDataFrame([("slow one",), ("plain",), ("other",)], "text string").coalesce(1)
    asked = remote.remote(flaky, "int", size=1, concurrency=2, timeout=0.5, retries=0)
    assert [tuple(r.a) for r in rows.select(asked(F.col("text")).alias("a")).collect()] == [(None, "timeout"), (5, None), (5, None)]
    short = remote.remote(lambda p: [1] * (len(p) - 1), "int", retries=0)
    assert {r.a.error for r in rows.select(short(F.col("text")).alias("a")).collect()} == {"ValueError"}


def test_calls_run_at_the_same_time_but_no_more():
    busy, most, lock = [0], [0], threading.Lock()

    def call(payloads):
        with lock:
            busy[0] += 1
            most[0] = max(most[0], busy[0])
        time.sleep(0.05)
        with lock:
            busy[0] -= 1
        return payloads

    caller = remote._Caller(call, 3, 5.0, 0, 0.0)
    futures = [caller.submit([k]) for k in range(12)]
    assert [f.result() for f in futures] == [[(k, None)] for k in range(12)] and 2 <= most[0] <= 3
    caller.close()


def test_classifier_keeps_what_it_cannot_judge(spark):
    rows = spark.createDataFrame([(1, "| contents"), (2, "| bad contents"), (3, "plain text")], "id int, text string")
    says = remote.answers(remote.remote(lambda p: [True for t in p if flaky([t])], "boolean", retries=0))
    assert {r.id for r in filters.without_toc(rows, says).collect()} == {2, 3}


def test_reranker_falls_back_to_the_base_order(spark):
    rows = spark.createDataFrame([(k, "x" * k, -float(k)) for k in range(1, 8)], "base_rank int, text string, score double")
    best = remote.reranked_remotely(rows, F.col("text"), remote.remote(flaky, "double"), 3)
    assert [(r.base_rank, r.score) for r in best.collect()] == [(7, 7.0), (6, 6.0), (5, 5.0)]
    broken = rows.withColumn("text", F.when(F.col("base_rank") == 5, "bad").otherwise(F.col("text")))
    best = remote.reranked_remotely(broken, F.col("text"), remote.remote(flaky, "double", retries=0), 3)
    assert [(r.base_rank, r.score) for r in best.collect()] == [(1, -1.0), (2, -2.0), (3, -3.0)]
