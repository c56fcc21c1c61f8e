"""Arrow functions that may be defined before a session is there."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    """A pandas UDF of a result type in DDL, built when it is called: reading DDL takes a session."""

    def put(fn: Callable) -> Callable[..., Column]:
        @wraps(fn)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(fn, schema)(*columns)

        return call

    return put
