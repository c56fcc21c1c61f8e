"""Keyed tables: bucketed changes, commits of two writers, versions."""

import pytest
from pyspark.sql import functions as F

from corpusloom.sources.keyed import Commits, Conflict, KeyedTable

SCHEMA = "key string, value string"


def pairs(df):
    return {r.key: r.value for r in df.collect()}


@pytest.fixture
def rows(spark):
    return lambda items: spark.createDataFrame(items, SCHEMA)


def test_changes_touch_their_buckets_only(spark, rows, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", buckets=8, slices=2)
    assert t.read(schema=SCHEMA).count() == 0 and t.get("a") is None and t.version() == 0
    with pytest.raises(FileNotFoundError):
        t.read()
    t.upsert(rows([(str(k), f"v{k}") for k in range(100)] + [(None, "null key")]))
    before = t.commits.latest()[1]["folders"]
    assert len(before) == 8 and t.read().count() == 101
    numbered = rows([("7", "old"), ("7", "new"), ("new", "x")]).withColumn("at", F.when(F.col("value") == "old", 1).otherwise(2))
    assert t.upsert(numbered, by="at") == 2
    after = t.commits.latest()[1]["folders"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2
    want = {str(k): f"v{k}" for k in range(100)} | {None: "null key", "7": "new", "new": "x"}
    assert pairs(t.read()) == want and t.get("7").first().value == "new" and t.get("none").count() == 0 and t.get(None).count() == 1
    t.delete(rows([("7", ""), (None, ""), ("no such", "")]).select("key"))
    del want["7"], want[None]
    assert pairs(t.read()) == want and t.version() == 3
    assert t.read(version=2).count() == 102  # earlier commits can still be read
    assert len(t.vacuum()) > 0 and pairs(t.read()) == want and t.commits.names("staged") == []
    t.delete(rows([(k, "") for k in want]).select("key"))
    assert t.read().count() == 0 and t.commits.latest()[1]["folders"] == {}
    t.upsert(rows([("again", "1")]))
    assert pairs(t.read()) == {"again": "1"}


def test_two_writers(spark, rows, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    a, b = KeyedTable(spark, root, buckets=16), KeyedTable(spark, root, buckets=16)
    a.upsert(rows([(str(k), "0") for k in range(64)]))
    # a writer that is overtaken between its merge and its commit
    real, others = Commits.commit, []

    def overtaken(self, after, state):
        if others:
            key, value = others.pop()
            b.upsert(rows([(key, value)]))
        return real(self, after, state)

    monkeypatch.setattr(Commits, "commit", overtaken)
    others.append(("5", "other"))
    a.upsert(rows([("5", "mine"), ("6", "mine")]))  # the same bucket: merged anew, the later commit wins
    assert (a.get("5").first().value, a.get("6").first().value) == ("mine", "mine") and a.version() == 3
    bucket = lambda k: k.select(a._bucket(a.commits.latest()[1])).first()[0]
    far = next(str(k) for k in range(64) if bucket(rows([(str(k), "")])) != bucket(rows([("5", "")])))
    others.append((far, "other"))
    a.upsert(rows([("5", "again")]))  # another bucket: both changes stay
    assert (a.get("5").first().value, a.get(far).first().value) == ("again", "other")
    with pytest.raises(Conflict):
        a.upsert(rows([("5", "late")]), expect=a.version() - 1)
    others.append((far, "third"))
    with pytest.raises(Conflict):
        a.upsert(rows([("5", "late")]), expect=a.version())
    assert (a.get("5").first().value, a.get(far).first().value, a.read().count()) == ("again", "third", 64)


def test_commits_are_taken_once(spark, tmp_path):
    log = Commits(spark, f"file://{tmp_path}/log")
    assert log.latest() == (0, {})
    assert log.commit(0, {"x": "é"}) and not log.commit(0, {"x": 2}) and log.commit(1, {"x": 3})
    assert log.latest() == (2, {"x": 3}) and log.latest(1) == (1, {"x": "é"}) and len(log.names("commits")) == 2


def test_overwrite_and_groups(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/g", key="doc_id", buckets=4)
    nodes = spark.createDataFrame([(d, f"{d}/{k}") for d in range(10) for k in range(3)], "doc_id long, node_id string")
    assert t.overwrite(nodes, least=30) == 1
    with pytest.raises(ValueError, match="version 1 stays"):
        t.overwrite(nodes.limit(2), least=3)
    t.replace(spark.createDataFrame([(3,), (4,), (99,)], "doc_id long"), nodes.where("doc_id = 3").limit(1))
    got = t.read().groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {d: 3 for d in range(10) if d not in (3, 4)} | {3: 1}
    # rows may come from the table itself
    t.replace(t.read().select("doc_id"), t.read().withColumn("node_id", F.lit("x")))
    assert t.read().where("node_id = 'x'").count() == 25
