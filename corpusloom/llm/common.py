"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the query contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    if (found := sc.getCheckpointDir()) is None:
        conf = sc.getConf()
        path = conf.get("spark.checkpoint.dir")
        if path is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="corpusloom-")
        sc.setCheckpointDir(path)
        found = sc.getCheckpointDir()
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch handed to Python, for every operator: texts may be long.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows. One bound for all operators, so that lazy plans don't depend on which was called last; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def trim() -> None:
    """Gives memory that a Python worker no longer uses back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names of internal columns, changed until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def digest(text: str = "text") -> Column:
    """A row's identity by its own text (null: empty), for joins that must not rest on ids."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def word_count(text: Column) -> Column:
    """Words of a text (null: 0), without building an array of them."""
    space = r"\x20\x09-\x0D"
    marks = F.regexp_replace(text, rf"[{space}]*+[^{space}]++[{space}]*+", "x")
    return F.coalesce(F.length(F.translate(marks, ASCII_SPACE, "")), F.lit(0)).cast("long")


def crc_fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the decimal id modulo ``parts``: the fixed folds of the contracts."""
    return F.crc32(doc_id.cast("string")) % parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
