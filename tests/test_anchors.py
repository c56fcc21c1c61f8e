"""Anchors on small cases whose answers are plain."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import anchors, chunking, search


def test_pages(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijklmno", k=7))
    sheets = [" ".join(word() for _ in range(120)) for _ in range(6)]
    pages = spark.createDataFrame([("d", k, t) for k, t in enumerate(sheets)], "doc_id string, page int, text string")
    nodes = [(f"n{k}", k, sheets[p][200:600]) for k, p in enumerate([0, 0, 3, 2, 5])] + [("short", 9, "too short"), ("none", 10, "9" * 400)]
    df = spark.createDataFrame([("d", *n) for n in nodes], "doc_id string, node_id string, ord int, text string")
    got = {r.node_id: r.page_number for r in anchors.page_locations(df, pages).collect()}
    assert got == {"n0": 1, "n1": 1, "n2": 4, "n3": 3, "n4": 6}


def test_fragments(spark):
    clean = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    hidden = "this hidden text is long enough to be looked at by the search"
    elements = [("d", 0, "p", clean, True, None), ("d", 1, "p", hidden, False, "Open the box"), ("d", 2, "p", "★ starred text that is visible yet unclean with a long clean tail of many plain words", True, None)]
    e = spark.createDataFrame(elements, "doc_id string, pos int, tag string, text string, visible boolean, title string")
    rows = [("d", "a", clean), ("d", "b", hidden), ("d", "c", elements[2][3]), ("d", "s", "x"), ("d", "n", "nothing like it " * 5), ("other", "o", clean)]
    n = spark.createDataFrame(rows, "doc_id string, node_id string, text string")
    got = {r.node_id: (r.search_text_start, r.search_text_end, r.anchor_type) for r in anchors.fragment_locations(n, e).collect()}
    assert got["a"] == ("one two three four five", "twelve thirteen fourteen fifteen sixteen", "text_fragment")
    assert got["b"][:2] == ("Open the box",) * 2
    assert got["c"][2] == "text_fragment" and "★" not in got["c"][0]
    assert [got[k][2] for k in "sno"] == ["too_short", "no_match", "no_text_elements"]
    audit = spark.createDataFrame([("a", None, None, None), ("b", "p", None, None), ("c", "p", "x", None), ("d", "p", None, 3)], "node_id string, parent_id string, search_text_start string, page_number int")
    assert [r.node_id for r in anchors.without_anchor(audit).collect()] == ["b"]


def test_rollup_labels(spark):
    hits = spark.createDataFrame([(1, 10, 0.1), (2, 10, 0.2), (3, 11, 0.3), (4, 12, 0.4), (5, 13, 0.5), (6, 99, 0.6)], "sub_id long, child_id long, distance double")
    children = spark.createDataFrame([(10, 1), (11, 1), (12, 7), (13, None)], "child_id long, parent_id long")
    rows = {r.sub_id: (r.context_id, r.label) for r in search.rolled_up(hits, children, spark.createDataFrame([(1,)], "parent_id long")).collect()}
    assert rows == {1: (1, "child->parent"), 4: (12, "error: parent missing"), 5: (13, "standalone")}


def test_pipeline_invariants(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    nodes = chunking.hierarchy(docs)
    children = nodes.where("level = 'child'")
    assert children.where("parent_id is null").count() == 0
    per = chunking.merged(chunking.line_nodes(docs), chunking.CHILD_SIZE)
    assert per.agg(F.sum("n_nodes")).first()[0] == chunking.line_nodes(docs).count()
    whole = lambda d: d.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("n"))
    assert whole(children).exceptAll(whole(chunking.line_nodes(docs))).count() == 0
    split = chunking.split_oversized(docs.select("doc_id", "text"), tokens=4000)
    assert split.where("half is not null").count() > 0 and split.select("doc_id").distinct().count() == docs.count()


def test_few_comparisons(spark, monkeypatch):
    """A page that contains a node ends the search, and others are ruled out by their grams; results stay those of all pairs."""
    from corpusloom.functions import fuzzy

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmno", k=7))
    texts = [" ".join(word() for _ in range(7)) for _ in range(3)]
    slips = [t[:20] + "zz" + t[23:] for t in texts] + [t[30:] + texts[0][:60] for t in texts]
    ratio = anchors._ratios()
    for a in texts + slips:
        for b in texts + slips:
            short, long = sorted((a, b), key=len)
            whole = max(fuzzy.ratio(short, long[max(0, k) : k + len(short)]) for k in range(1 - len(short), len(long)))
            assert anchors._contained(a, b) == (whole == 100.0)
            for cutoff in (0.0, 50.0, 90.0, 95.0):
                assert abs(ratio(a, b, cutoff) - (whole if whole >= cutoff else 0.0)) < 1e-9
    calls = []
    monkeypatch.setattr(fuzzy, "_lcs", lambda *x: calls.append(x) or 0)
    ratio = anchors._ratios()
    assert all(ratio(a, b, 90.0) == 0.0 for a in texts for b in texts if a is not b) and not calls
    # comparing is dealt to as many tasks as asked for, however few bytes the texts have
    docs = spark.createDataFrame([(k, f"n{k}", 1, t) for k, t in enumerate(texts)], "doc_id long, node_id string, ord int, text string")
    pages = docs.selectExpr("doc_id", "0 as page", "text")
    found = anchors.page_locations(docs, pages)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {tuple(r) for r in found.collect()} == {(f"n{k}", 1, 100.0) for k in range(len(texts))}
