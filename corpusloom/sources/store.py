"""Tables of one library: nodes, vectors, status and cache, as Parquet below one folder.

Writes go to a new folder, and a numbered commit names it, so readers never see half a table, two
writers never share a folder, and a publish can be refused. Tables by key (the node store, and the
tables of a build, by document) change bucket by bucket.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyed import Commits, KeyedTable

NODES = "key string, value string"
STATUS = "library_id string, status string, started double, finished double, num_documents long, error string, at double"


class Library:
    def __init__(self, spark: SparkSession, root: str, library_id: str, buckets: int = 64) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", library_id):
            raise ValueError(f"not a library id: {library_id!r}")
        self.spark, self.library_id, self.root, self.buckets = spark, library_id, f"{root.rstrip('/')}/{library_id}", buckets

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def commits(self, name: str) -> Commits:
        return Commits(self.spark, f"{self.root}/{name}")

    def keyed(self, name: str, key: str = "key") -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/{name}", key, self.buckets)

    def _current(self, name: str) -> int:
        return self.commits(name).latest()[0]

    def version(self) -> str:
        """Of nodes and vectors: it changes with every build or update."""
        return f"{self._current('hierarchy')}.{self._current('vectors')}"

    def publish(self, name: str, df: DataFrame, least: int = 0) -> int:
        """Writes the whole table anew; refused below ``least`` rows."""
        log, folder = self.commits(name), uuid.uuid4().hex
        version = log.latest()[0]
        path = f"{self.root}/{name}/data/{folder}"
        df.write.parquet(path)
        if least and (n := self.spark.read.parquet(path).count()) < least:
            raise ValueError(f"{n} rows, at least {least} are wanted; version {version} stays")
        while not log.commit(version, {"path": folder}):
            version = log.latest()[0]
        return version + 1

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        version, state = self.commits(name).latest()
        if "path" in state:
            return self.spark.read.parquet(f"{self.root}/{name}/data/{state['path']}")
        if version:
            return self.keyed(name).read(version)
        if schema is None:
            raise FileNotFoundError(f"{self.library_id} has no {name}")
        return self.spark.createDataFrame([], schema)

    # key/value store

    def put_all(self, rows: DataFrame, name: str = "nodes", by: str | None = None) -> None:
        """Upsert of (key, value); of a repeated key the row with the greatest ``by`` stays."""
        self.keyed(name).upsert(rows, by)

    def get(self, key: str, name: str = "nodes") -> str | None:
        found = self.keyed(name).get(key)
        row = found.select("value").first() if found is not None else None
        return row[0] if row else None

    def get_all(self, name: str = "nodes") -> DataFrame:
        return self.read(name, NODES)

    def delete(self, key: str, name: str = "nodes") -> bool:
        had = self.get(key, name) is not None
        if had:
            self.keyed(name).delete(self.spark.createDataFrame([(key,)], "key string"))
        return had

    def count(self, name: str = "nodes") -> int:
        return self.read(name, NODES).count()

    # vectors

    def save_vectors(self, chunks: DataFrame) -> None:
        self.publish("vectors", chunks)

    def vectors(self) -> DataFrame:
        return self.read("vectors")

    # status

    def set_status(self, status: str, started: float | None = None, finished: float | None = None, num_documents: int | None = None, error: str | None = None) -> None:
        row = [(self.library_id, status, started, finished, num_documents, error, time.time())]
        self.spark.createDataFrame(row, STATUS).coalesce(1).write.mode("append").parquet(f"{self.root}/status")

    def status(self) -> dict:
        if not self._exists(f"{self.root}/status"):
            return {"library_id": self.library_id, "status": "not_found"}
        latest = self.spark.read.schema(STATUS).parquet(f"{self.root}/status").agg(F.max_by(F.struct("*"), "at").alias("s")).first()[0]
        return latest.asDict()
