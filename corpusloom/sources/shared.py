"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may go without it, and gets a temporary folder."""
    sc = spark.sparkContext
    if (found := sc.getCheckpointDir()) is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if path is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="corpusloom-")
        sc.setCheckpointDir(path)
        found = sc.getCheckpointDir()
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch handed to Python where whole documents are: a task holds several Python workers at once.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
