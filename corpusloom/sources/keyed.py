"""Tables that change by key: buckets of Parquet files, of which a change rewrites the touched ones only.

A table's state (which folder holds each bucket) is a numbered commit. A commit is a file that only
one writer can create, so of two writers the later one sees that it was overtaken: it keeps its
files if the other changed other buckets, merges anew if not, or is refused if it asked for a
certain version. Readers see one commit and never half a change; folders that no commit names
stay until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS, TRIES = 64, 10
_BUCKET = "_bucket"


class Conflict(Exception):
    """Another writer came first."""


class Commits:
    """Numbered states (JSON) below one folder; number 0 is the empty state before the first."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):  # noqa: ANN202
        return self._path("commits").getFileSystem(self._conf)

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        path = self._path(folder)
        return [s.getPath().getName() for s in self._files().listStatus(path)] if self._files().exists(path) else []

    def latest(self, number: int | None = None) -> tuple[int, dict]:
        """The last commit, or the one asked for."""
        if number is None:
            number = max((int(n[:-5]) for n in self.names("commits") if n.endswith(".json")), default=0)
        if not number:
            return 0, {}
        stream = self._files().open(self._path(f"commits/{number:010d}.json"))
        try:
            return number, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, after: int, state: dict) -> bool:
        """Makes ``state`` the commit that follows ``after``; False if there is one already."""
        own, final = self._path(f"commits/.{uuid.uuid4().hex}"), self._path(f"commits/{after + 1:010d}.json")
        out = self._files().create(own, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            # a rename that doesn't replace: one writer only gets the name, and readers get whole files
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(own, final, none)
        except Py4JJavaError as error:
            self._files().delete(own, False)
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            return False
        return True

    def delete(self, name: str) -> None:
        self._files().delete(self._path(name), True)


class KeyedTable:
    """Rows by a key; ``upsert`` keeps one row a key, ``replace`` any number.

    ``slices`` is the number of files a bucket is written in. Null is a key like others.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "key", buckets: int = BUCKETS, slices: int = 1) -> None:
        self.spark, self.root, self.key, self.slices = spark, root.rstrip("/"), key, slices
        self.commits = Commits(spark, root)
        self._buckets = buckets

    def version(self) -> int:
        return self.commits.latest()[0]

    def _spread(self, state: dict) -> int:
        """A table keeps the number of buckets that it began with."""
        return state.get("buckets", self._buckets)

    def _bucket(self, state: dict) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self._spread(state))).cast("int")

    def _rows(self, state: dict, buckets: list[str] | None = None) -> DataFrame | None:
        folders = state.get("folders", {})
        paths = [f"{self.root}/data/{folder}/{_BUCKET}={b}" for b, folder in folders.items() if buckets is None or b in buckets]
        if "path" in state:
            raise ValueError(f"{self.root} was published whole and has no keys")
        if "schema" not in state:
            return None
        schema = StructType.fromJson(state["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None, schema: str | None = None) -> DataFrame:
        """The rows of the last commit, or of an earlier one."""
        rows = self._rows(self.commits.latest(version)[1])
        if rows is None:
            if schema is None:
                raise FileNotFoundError(f"no table in {self.root}")
            return self.spark.createDataFrame([], schema)
        return rows

    def get(self, value: object) -> DataFrame | None:
        """The rows of one key: one bucket is read, and of it the row groups that may hold the key. None without a table."""
        state = self.commits.latest()[1]
        if "schema" not in state:
            return None
        kind = next(f["type"] for f in state["schema"]["fields"] if f["name"] == self.key)
        key = self.spark.range(1).select(F.lit(value).cast(kind).alias(self.key))
        bucket = str(key.select(self._bucket(state)).first()[0])
        return self._rows(state, [bucket]).where(F.col(self.key).eqNullSafe(F.lit(value).cast(kind)))

    def _written(self, rows: DataFrame, state: dict) -> dict[str, str]:
        """Writes rows in buckets; the folder of each bucket that has any."""
        folder = uuid.uuid4().hex
        slot = F.pmod(F.shiftright(F.xxhash64(F.col(self.key)), 32), F.lit(self.slices))
        dealt = rows.withColumn(_BUCKET, self._bucket(state)).repartition(F.col(_BUCKET), slot).sortWithinPartitions(_BUCKET, self.key)
        dealt.write.partitionBy(_BUCKET).parquet(f"{self.root}/data/{folder}")
        return {n.split("=")[1]: folder for n in self.commits.names(f"data/{folder}") if n.startswith(f"{_BUCKET}=")}

    def overwrite(self, rows: DataFrame, least: int = 0) -> int:
        """All rows anew; refused below ``least`` rows."""
        version, state = self.commits.latest()
        new = {"buckets": self._spread(state), "schema": rows.schema.jsonValue()}
        new["folders"] = self._written(rows, new)
        if least and (n := self._rows(new).count()) < least:
            raise ValueError(f"{n} rows, at least {least} are wanted; version {version} stays")
        while not self.commits.commit(version, new):
            version = self.commits.latest()[0]
        return version + 1

    def replace(self, keys: DataFrame, rows: DataFrame, expect: int | None = None, held: bool = False) -> int:
        """Takes out all rows of ``keys`` and puts ``rows`` in; refused if ``expect`` isn't the last commit.

        Both are written down first, so that a further try repeats only the merge and they may come
        from the table itself; ``held`` rows are read from files that stay, and aren't written again.
        Touched buckets alone are read and written. Gives the commit's number.
        """
        at = f"{self.root}/staged/{uuid.uuid4().hex}"
        keys.select(F.col(keys.columns[0]).alias(self.key)).distinct().write.parquet(f"{at}/keys")
        keys = self.spark.read.parquet(f"{at}/keys")
        if not held:
            rows.write.parquet(f"{at}/rows")
            rows = self.spark.read.schema(rows.schema).parquet(f"{at}/rows")
        for _ in range(TRIES):
            version, state = self.commits.latest()
            if expect is not None and version != expect:
                raise Conflict(f"{self.root} is at commit {version}, not {expect}")
            state = {"folders": {}, "schema": rows.schema.jsonValue(), "buckets": self._spread(state)} | state
            touched = [str(r[0]) for r in keys.select(self.key).union(rows.select(self.key)).select(self._bucket(state)).distinct().collect()]
            old, gone = self._rows(state, touched), keys.withColumnRenamed(self.key, "_gone")
            merged = old.join(gone, old[self.key].eqNullSafe(gone["_gone"]), "left_anti").unionByName(rows)
            own = self._written(merged, state)
            while True:
                folders = {b: f for b, f in state["folders"].items() if b not in touched} | own
                if self.commits.commit(version, state | {"folders": folders}):
                    self.commits.delete(f"staged/{at.rsplit('/', 1)[1]}")
                    return version + 1
                if expect is not None:
                    raise Conflict(f"{self.root} has left commit {expect}")
                was, (version, state) = state["folders"], self.commits.latest()
                if any(was.get(b) != state["folders"].get(b) for b in touched):
                    break  # the same buckets: merge again
        raise Conflict(f"{self.root}: {TRIES} times others came first")

    def upsert(self, rows: DataFrame, by: str | None = None, expect: int | None = None) -> int:
        """One row a key: the one with the greatest ``by`` (a column that isn't kept), which is the last."""
        kept = [c for c in rows.columns if c != by]
        last = [F.col(by)] if by else []
        one = rows.groupBy(self.key).agg(F.max_by(F.struct(*kept), F.struct(*last, F.xxhash64(*kept))).alias("_row")).select("_row.*")
        return self.replace(rows.select(self.key), one, expect)

    def delete(self, keys: DataFrame, expect: int | None = None) -> int:
        none = self._rows(self.commits.latest()[1])
        return self.replace(keys, none.limit(0), expect) if none is not None else 0

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes files that none of the last ``keep`` commits names; run it when no writer is at work."""
        number = self.version()
        named = {(f, b) for n in range(max(1, number - keep + 1), number + 1) for b, f in self.commits.latest(n)[1]["folders"].items()}
        held = {f for f, _ in named}
        old = []
        for folder in self.commits.names("data"):
            parts = [n for n in self.commits.names(f"data/{folder}") if n.startswith(f"{_BUCKET}=")]
            old += [f"{folder}/{n}" for n in parts if (folder, n.split("=")[1]) not in named] if folder in held else [folder]
        for name in old:
            self.commits.delete(f"data/{name}")
        for folder in self.commits.names("staged"):
            self.commits.delete(f"staged/{folder}")
        return old
