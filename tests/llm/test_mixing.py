import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.llm import mixing, queries


def water_fill(sizes, weights=(5, 2, 1), epochs=3):
    """Clamps and reshares until nothing is above; sizes by source, in rank order."""
    w = {s: weights[k % 3] for k, s in enumerate(sizes)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(epochs * sizes[s] for s in capped)
        open_w = sum(w[s] for s in sizes if s not in capped)
        target = {s: epochs * sizes[s] if s in capped else left * w[s] / open_w for s in sizes}
        above = {s for s in sizes if s not in capped and target[s] > epochs * sizes[s]}
        if not above:
            return target
        capped |= above


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets_and_sizes(spark, sf):
    got = queries.op7_source_mix(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes = Counter()
    for r in sorted(docs.values(), key=lambda r: r.source):
        sizes[r.source] += words(r.text)
    want = water_fill(dict(sorted(sizes.items())))
    taken = Counter()
    assert len(got) == len(docs)
    for r in got:
        s = docs[r.doc_id].source
        assert r.size == words(docs[r.doc_id].text) and r.source_size == sizes[s]
        assert abs(r.target - want[s]) < 1e-6 * want[s]
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.05 * want[s], (s, taken[s], want[s])
    again = {r.doc_id: r.taken for r in queries.op7_source_mix(spark, sf).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_caps_bind(spark):
    rows = [(k, "w " * 10, "a") for k in range(4)] + [(10 + k, "w " * 10, "b") for k in range(400)] + [(1000, "w " * 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: r for r in mixing.mix(df).groupBy("source").agg(F.max("target").alias("t"), F.sum(F.col("size") * F.col("reps")).alias("n")).collect()}
    want = water_fill({"a": 40, "b": 4000, None: 7})
    assert {s: round(r.t, 6) for s, r in got.items()} == {s: round(t, 6) for s, t in want.items()}
    assert got["a"].n == 120 and got[None].n == 21 and abs(got["b"].n - want["b"]) <= 40


def test_large_documents(spark):
    """Large documents make up what the others can't, and the target is missed by at most half a document."""
    rnd = random.Random(5)
    shapes = {"a": [400] + [10] * 60, "b": [100] * 10, "c": [400, 300, 300], "d": [900] + [1] * 100, "e": [rnd.randrange(1, 400) for _ in range(30)], "f": [5] * 3000, "g": [250, 250, 250] + [2] * 125}
    rows, sizes = [], {}
    for s, held in shapes.items():
        sizes[s] = sum(held)
        rows += [(len(rows) + k, s, n) for k, n in enumerate(held)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    for seed, weights in ((1, (5, 2, 1)), (2, (3, 4, 2)), (7, (1, 1, 1))):
        plan, more, sized = mixing.plan_mix(df, seed, weights)
        got = mixing.apply_mix(sized, plan, more, seed).groupBy("source").agg(F.max("target").alias("t"), F.sum(F.col("size") * F.col("reps")).alias("n"), F.max("reps").alias("r")).collect()
        want = water_fill(sizes, weights)
        for r in got:
            assert abs(r.t - want[r.source]) < 1e-6 * r.t and r.r <= 3
            assert abs(r.n - r.t) <= max(shapes[r.source]) / 2, (seed, r)


def test_made_up(spark):
    """A source of 1,000 words of which 783 are due: one document of 400 words and 60 of 10."""
    rows = [(k, "a", 400 if not k else 10) for k in range(61)] + [(100 + k, "b", 10) for k in range(0, 2132)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    for seed in range(4):
        weights = (1.0, 21537 / 783)
        plan, more, sized = mixing.plan_mix(df, seed, weights)
        r = mixing.apply_mix(sized, plan, more, seed).where("source = 'a'").agg(F.max("target").alias("t"), F.sum(F.col("size") * F.col("reps")).alias("n")).first()
        assert 780 < r.t < 786 and abs(r.n - r.t) <= 8, (seed, r)


def test_odd_rows(odd, none):
    got = mixing.mix(odd)
    assert got.count() == odd.count() and {"source_size", "target", "reps"} <= set(got.columns)
    same = [r.reps for r in got.where("doc_id = 4").collect()]
    assert len(set(same)) == 1
    assert mixing.mix(none).count() == 0
    assert mixing.repeated(odd).count() == got.agg(F.sum("reps")).first()[0]


def test_clashing_names(odd):
    names = ["size", "target", "source_size", "reps", "row", "_h", "_salt", "_reps", "_b0", "_over", "_eid", "_esource", "_esize", "_more", "_psource", "col"]
    df = odd.withColumns({c: F.lit(f"own {c}") for c in names})
    got = mixing.mix(df).collect()
    assert [r.reps for r in sorted(got, key=str)] and all(r._h == "own _h" and r.row == "own row" and isinstance(r.size, int) and r.kept == 3 for r in got)
    assert sorted((r.doc_id or 0, r.reps) for r in got) == sorted((r.doc_id or 0, r.reps) for r in mixing.mix(odd).collect())
    again = mixing.repeated(df)
    assert again.columns == df.columns and all(r.target == "own target" and r.col == "own col" for r in again.collect())


def test_sql(spark, sf, tmp_path):
    import duckdb

    con = duckdb.connect()
    made = str(tmp_path)
    rows = [(k, s, "w " * n) for k, (s, n) in enumerate([("a", 400)] + [("a", 10)] * 60 + [("b", 100)] * 10 + [("c", n) for n in (400, 300, 300)] + [("d", 5)] * 3000 + [(None, 9), (None, 4)])]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{made}/documents.parquet")
    for where in (sf, "/root/testdata/sf0.1", made):
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{where}/documents.parquet{'/*.parquet' if where == made else ''}')")
        want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({queries.SQL['op7_source_mix']})").fetchall()}
        got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in queries.op7_source_mix(spark, where).collect()}
        assert got == want
