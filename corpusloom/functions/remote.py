"""Calls of remote models (embedding, reranking, classification) as column functions.

A call takes a list of payloads and gives a list of answers. In each task ``concurrency`` calls of
``size`` payloads run at the same time, over the borders of Arrow batches; rows keep their order. A call that
raises, exceeds ``timeout`` or answers with another number is repeated ``retries`` times, with a wait that doubles; then
its payloads are tried one by one, so one bad row costs only itself. What still fails becomes null
with its error's kind, and the row stays. Null payloads aren't sent and give null without an error.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Call = Callable[[list], list]
SIZE, CONCURRENCY, TIMEOUT, RETRIES, WAIT = 32, 8, 30.0, 2, 0.5


class _Caller:
    """One task's calls: threads for attempts, and others that wait for them, so that a hanging attempt can be given up."""

    def __init__(self, call: Call, concurrency: int, timeout: float, retries: int, wait: float) -> None:
        self.call, self.timeout, self.retries, self.wait = call, timeout, retries, wait
        self.waiting = ThreadPoolExecutor(concurrency)
        self.concurrency = concurrency
        self.attempts = ThreadPoolExecutor(concurrency)

    def _attempt(self, payloads: list) -> list:
        future = self.attempts.submit(self.call, payloads)
        try:
            answers = list(future.result(self.timeout))
        except Late:
            if not future.cancel():  # it hangs: its thread is given up with its pool
                self.attempts = ThreadPoolExecutor(self.concurrency)
            raise
        if len(answers) != len(payloads):
            raise ValueError(f"{len(answers)} answers to {len(payloads)} payloads")
        return answers

    def _repeated(self, payloads: list) -> tuple[list | None, str | None]:
        for turn in range(self.retries + 1):
            try:
                return self._attempt(payloads), None
            except Exception as error:  # noqa: BLE001
                kind = "timeout" if isinstance(error, Late) else type(error).__name__
            if turn < self.retries:
                time.sleep(self.wait * 2**turn)
        return None, kind

    def answered(self, payloads: list) -> list[tuple]:
        """(answer, error) of each payload."""
        sent = [p for p in payloads if p is not None]
        answers, error = self._repeated(sent) if sent else ([], None)
        if answers is not None:
            found = iter([(a, None) for a in answers])
        else:
            alone = [self._repeated([p]) for p in sent] if len(sent) > 1 else [(None, error)]
            found = iter([(a[0] if a else None, e) for a, e in alone])
        return [(None, None) if p is None else next(found) for p in payloads]

    def submit(self, payloads: list) -> Future:
        return self.waiting.submit(self.answered, payloads)

    def close(self) -> None:
        self.waiting.shutdown(wait=False, cancel_futures=True)
        self.attempts.shutdown(wait=False, cancel_futures=True)


def remote(call: Call, result: str, size: int = SIZE, concurrency: int = CONCURRENCY, timeout: float = TIMEOUT, retries: int = RETRIES, wait: float = WAIT) -> Callable[[Column], Column]:
    """A column function that gives struct<answer, error> of payloads; ``result`` is the answer's type."""

    def asked(payload: Column) -> Column:
        @F.pandas_udf(f"struct<answer:{result},error:string>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            caller = _Caller(call, concurrency, timeout, retries, wait)
            ahead: deque[list[Future]] = deque()

            def done() -> pd.DataFrame:
                rows = [row for future in ahead.popleft() for row in future.result()]
                return pd.DataFrame({"answer": pd.Series([a for a, _ in rows], dtype=object), "error": pd.Series([e for _, e in rows], dtype=object)})

            try:
                for batch in batches:
                    # pandas has no nulls of its own in object columns; NaN stands for them in others
                    payloads = [None if p is None or p is pd.NA or p != p else p for p in batch.tolist()]  # noqa: PLR0124
                    ahead.append([caller.submit(payloads[at : at + size]) for at in range(0, len(payloads), size)])
                    # results go out as late as the number of calls in hand allows
                    while len(ahead) > 1 and sum(map(len, ahead)) > concurrency:
                        yield done()
                while ahead:
                    yield done()
            finally:
                caller.close()

        return run(payload)

    return asked


def answers(asked: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The answers alone, null where a call failed: an embedder or classifier for builds."""
    return lambda payload: asked(payload)["answer"]


def reranked_remotely(rows: DataFrame, payload: Column, asked: Callable[[Column], Column], top_n: int) -> DataFrame:
    """rows (base_rank, ..) with score, the best ``top_n``; if any call failed, the first ``top_n`` in base order as they are.

    For the results of one request, which are few.
    """
    scored = rows.withColumn("_asked", asked(payload))
    every = Window.partitionBy(F.lit(1))
    failed = F.max(F.col("_asked.error").isNotNull()).over(every)
    judged = scored.withColumn("_failed", failed).withColumn("score", F.when(~F.col("_failed"), F.col("_asked.answer")).otherwise(F.col("score") if "score" in rows.columns else F.lit(None).cast("double")))
    order = F.when(F.col("_failed"), F.lit(None).cast("double")).otherwise(F.col("score"))
    return judged.orderBy(F.desc_nulls_last(order), "base_rank").limit(top_n).drop("_asked", "_failed")
