"""Sections, index build, search requests, cache and the batch search against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, markdown, search
from corpusloom.sources import answers, cache, index
from corpusloom.sources.store import Library

MARKDOWN = "intro\n# A\ntext a\n## B\ntext b\n```\n# no header\n```\n### C\n\n## D\ntext d\n# E\n\n# F\ntext f"


def test_sections(spark):
    rows = spark.createDataFrame([(1, MARKDOWN, "x"), (2, None, "y"), (3, "", "z"), (4, "## only\r", "w")], "doc_id long, text string, title string")
    got = [tuple(r) for r in markdown.sections(rows.withColumnRenamed("title", "file_name")).orderBy("doc_id", "ord").collect()]
    assert got == [
        (1, 0, 0, "", "/", "intro", "x"), (1, 1, 1, "A", "/", "# A\ntext a", "x"), (1, 2, 2, "B", "/A/", "## B\ntext b\n```\n# no header\n```", "x"),
        (1, 3, 3, "C", "/A/B/", "### C", "x"), (1, 4, 2, "D", "/A/", "## D\ntext d", "x"), (1, 5, 1, "E", "/", "# E", "x"), (1, 6, 1, "F", "/", "# F\ntext f", "x"),
        (4, 0, 2, "only", "/", "## only", "w"),
    ]
    # a column of a section's own name gives way
    assert markdown.sections(rows).columns == ["doc_id", "ord", "level", "title", "header_path", "text"]


def test_sections_do_not_shuffle(spark):
    plan = markdown.sections(spark.createDataFrame([(1, MARKDOWN)], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_batch_nearest(spark):
    rng = np.random.default_rng(5)
    vectors = rng.integers(-3, 4, (700, 6)).astype(np.float32)  # few values, so that many distances tie
    vectors[50:250] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame([*rows, (9999, None)], "sub_id long, embedding array<float>").repartition(5)
    queries = chunks.where("sub_id % 20 = 0 or sub_id = 9999").select(F.col("sub_id").alias("query_id"), F.col("embedding").alias("q"))
    want = set()
    for i in range(0, 700, 20):
        d = np.round(((vectors.astype(float) - vectors[i]) ** 2).sum(axis=1), 6)
        want |= {(i, int(j), float(d[j]), r + 1) for r, j in enumerate(np.lexsort((np.arange(700), d))[:7])}
    for group_bytes in (1 << 20, 500):
        assert {tuple(r) for r in search.batch_nearest(chunks, queries, 7, group_bytes).collect()} == want
    assert len(search.batch_nearest(chunks.limit(3), queries, 7).collect()) > 0
    assert search.batch_nearest(chunks, queries.limit(0), 7).count() == 0
    assert search.batch_nearest(chunks.where("false"), queries, 7).count() == 0


def test_first_nodes_fields_and_halves(spark):
    text = lambda c, n: (c * 9 + " ") * (n // 10)
    rows = [("d", k, text(c, 1800), f"/{c}/") for k, c in enumerate("abcde")]
    sections = spark.createDataFrame(rows, "doc_id string, ord int, text string, header_path string")
    nodes = chunking.section_hierarchy(sections)
    assert {(r.node_id, r.header_path) for r in nodes.collect()} == {("d/c/%d" % k, f"/{c}/") for k, c in enumerate("abcde")} | {("d/p/0", "/a/"), ("d/p/1", "/b/"), ("d/p/2", "/d/")}
    cut = {r.node_id: r for r in chunking.halves_linked(nodes, chars=3000, tokens=500).collect()}
    assert {k for k in cut if "/p/" in k} == {"d/p/0", "d/p/1/0", "d/p/1/1", "d/p/2/0", "d/p/2/1"}
    assert [cut[f"d/c/{k}"].parent_id for k in range(5)] == ["d/p/0", "d/p/1/0", "d/p/1/1", "d/p/2/0", "d/p/2/1"]
    assert all(r.parent_id is None or r.parent_id in cut for r in cut.values())
    assert cut["d/p/1/0"].next_id == "d/p/1/1" and cut["d/p/1/1"].next_id == "d/p/2/0"


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    docs = [
        ("a.md", "a.md", "https://x.org/fr/a", "# Cats\n" + "cats purr and sleep all day long. " * 12 + "\n# Dogs\n" + "dogs bark at the postman. " * 12),
        ("b.md", "b.md", "https://x.org/en/b", "# Trains\n" + "trains leave the station on time. " * 12),
        ("n.md", "n.md", None, None),
    ]
    lib = Library(spark, str(tmp_path_factory.mktemp("libs")), "animals", buckets=2)
    rows = spark.createDataFrame(docs, "doc_id string, file_name string, source_url string, text string")
    assert index.build(lib, rows)["status"] == "done"
    return lib


def test_build(library):
    nodes = {r.node_id: r for r in library.read("hierarchy").collect()}
    assert nodes["a.md/c/0"].header_path == "/" and nodes["a.md/c/0"].source_url == "https://x.org/fr/a"
    assert all(r.parent_id in nodes for r in nodes.values() if r.level == "child")
    assert {r.child_id for r in library.vectors().collect()} == {k for k, r in nodes.items() if r.level == "child"}
    assert library.status()["num_documents"] == 3


def test_answers(spark, library):
    ask = lambda *a, **k: [r.title for r in answers.answer(library, answers.Request(*a, **k)).collect()]
    assert ask("trains leave the station")[0] == "b.md"
    plain = answers.answer(library, answers.Request("dogs bark", rerank=False)).collect()
    assert {r.title for r in plain} == {"a.md", "b.md"} and [r.score for r in plain] == sorted((r.score for r in plain), reverse=True)
    assert ask("trains leave the station", url_prefix="fr") == ["a.md"]
    row = answers.answer(library, answers.Request("dogs bark")).first()
    assert row.context_content.startswith("# Cats") and row.node_hierarchy == "child->parent" and len(row) == 14


def test_cache(spark, library):
    held = cache.ResultCache(library, most=2)
    request = answers.Request("trains leave the station")
    rows = lambda c, r=request: [tuple(x)[:4] for x in answers.answer(library, r, cache=c).collect()]
    first = rows(held)
    assert held.stats() == {"ram_hits": 0, "disk_hits": 0, "misses": 1, "writes": 1, "hit_rate": 0.0}
    assert [r[0] for r in rows(held)] == [r[0] for r in first] and held.counts["ram_hits"] == 1
    assert answers.answer(library, request, cache=held).first().node_hierarchy == "cached"
    other = cache.ResultCache(library, most=2)  # another driver: the table answers, then memory
    rows(other), rows(other)
    assert (other.counts["disk_hits"], other.counts["ram_hits"], other.stats()["hit_rate"]) == (1, 1, 100.0)
    rows(other, answers.Request("trains", rerank=False))
    assert other.counts["misses"] == 0 and other.counts["writes"] == 0
    for q in ("cats", "dogs"):
        rows(held, answers.Request(q))
    assert len(held.held) == 2 and held.entries().count() == 2
    held.put("gone", [("no/c/0", "no/p/0", 1.256), ("b.md/c/0", "b.md/p/0", 0.5)])
    assert held.get("gone")[0][2] == 1.26 and answers.from_cache(library, held.get("gone")).count() == 1
    held.clear()
    assert not held.held and held.get("gone") is None and cache.ResultCache(library).get("gone") is None
    assert answers.from_cache(library, []).count() == 0


def test_no_stale_hit_after_a_rebuild(spark, tmp_path):
    """The same id names another passage after a rebuild; neither tier answers with the old one's place."""
    lib = Library(spark, str(tmp_path), "again", buckets=2)
    docs = lambda text: spark.createDataFrame([("a.md", "a.md", "u", text)], "doc_id string, file_name string, source_url string, text string")
    held, request = cache.ResultCache(lib), answers.Request("trains leave")
    ask = lambda: answers.answer(lib, request, cache=held).first()
    index.build(lib, docs("# Trains\ntrains leave on time"))
    assert "on time" in ask().precise_content and ask().node_hierarchy == "cached"
    index.build(lib, docs("# Boats\nboats stay in the harbour"))
    again = ask()
    assert "harbour" in again.precise_content and again.node_hierarchy != "cached" and held.counts["misses"] == 2
    index.update(lib, docs("# Cars\ncars drive"))
    assert "drive" in ask().precise_content and held.counts["misses"] == 3


def test_cache_of_two_drivers(spark, tmp_path, monkeypatch):
    """Writes during a compaction and compactions at the same time lose no entry."""
    lib = Library(spark, str(tmp_path), "shared", buckets=2)
    a, b = cache.ResultCache(lib, files=3), cache.ResultCache(lib, files=1000)
    entry = lambda n: [(f"c{n}", "p", n / 3)]
    a.put("1", entry(1)), b.put("2", entry(2))
    assert cache.ResultCache(lib).get("1") == [("c1", "p", 0.33)] and cache.ResultCache(lib).get("2") is not None
    newest = cache.ResultCache._newest

    def meanwhile(self, parts):
        out = newest(self, parts)
        if self is a and not b.held.get("4"):
            b.put("4", entry(4))
        return out

    monkeypatch.setattr(cache.ResultCache, "_newest", meanwhile)
    real, late = b._open, []

    def closed_meanwhile():
        """b learns the open part, then a compacts, then b writes."""
        state = real()
        if not late:
            late.append(1)
            assert a.compact()
        return state

    b._open = closed_meanwhile
    b.put("3", entry(3))
    monkeypatch.undo()
    assert {r.key for r in cache.ResultCache(lib).entries().collect()} == {"1", "2", "3", "4"}
    for n in range(5, 9):
        a.put(str(n), entry(n))
    number, state = a.log.latest()
    assert len(state["closed"]) == 1 and number >= 5
    a.put("1", entry(9))
    fresh = cache.ResultCache(lib, most=3)
    asked = spark.createDataFrame([("1",), ("7",), ("no",)], "key string")
    assert {r.key: r.rows and r.rows[0][0] for r in fresh.lookup(asked).collect()} == {"1": "c9", "7": "c7", "no": None}
    assert fresh.compact() and {r.key for r in fresh.entries().collect()} == {"1", "8", "7"}
    fresh.put_all(spark.createDataFrame([("x", entry(7), 1e12)], cache.ENTRY))
    assert fresh.get("x") == [("c7", "p", 2.33)]


def test_gate_of_a_request(spark, library):
    gate = answers.Gate("k", "p")
    for key, password, status in ((None, "p", 422), ("x", "p", 403), ("k", None, 401), ("k", "x", 403)):
        with pytest.raises(answers.Refused) as caught:
            answers.answer(library, answers.Request("cats", key=key, password=password), gate=gate)
        assert caught.value.status == status
    assert answers.answer(library, answers.Request("cats", key="k", password="p"), gate=gate).count() > 0


def test_places_reach_the_results(spark, tmp_path):
    """A child's page makes a deep link, its fragment the search texts, through build, cache and update."""
    body = {n: " ".join(f"{n}{k} word{k}" for k in range(60)) for n in ("alpha", "beta")}
    docs = spark.createDataFrame([("a.pdf", "a.pdf", "https://x.org/a.pdf", "\n".join(f"# {n.title()}\n{t * 3}" for n, t in body.items()))], "doc_id string, file_name string, source_url string, text string")
    pages = spark.createDataFrame([("a.pdf", 0, "cover page with nothing that is searched for"), ("a.pdf", 1, body["alpha"] * 3), ("a.pdf", 2, body["beta"] * 3)], "doc_id string, page int, text string")
    lib = Library(spark, str(tmp_path), "places", buckets=2)
    cut = lambda d: index.located(index.index_nodes(d), pages)
    index.build(lib, docs, cut=cut)
    held = cache.ResultCache(lib)
    for _ in range(2):
        row = answers.answer(lib, answers.Request("beta7 beta8 beta9"), cache=held).first()
        assert (row.page_number, row.file_url, row.file_type) == (3, "https://x.org/a.pdf#page=3", "pdf") and row.page_confidence > 90
    assert held.counts["ram_hits"] == 1


def test_backfill_of_a_library(spark, tmp_path):
    docs = [("a", "a.md", None, "text of a"), ("b", "b.md", "", "text of b"), ("c", "c.md", "https://own", "text of c"), ("d", "d.md", None, "text of d")]
    lib = Library(spark, str(tmp_path), "back", buckets=2)
    index.build(lib, spark.createDataFrame(docs, "doc_id string, file_name string, source_url string, text string"), cut=index.plain_nodes)
    side = spark.createDataFrame([("a.md", "https://a"), ("b.md", "https://b"), ("c.md", "https://other")], "file_name string, url string")
    version, want = lib.version(), {"kept": 2, "filled": 4, "unfixable": 2, "files": ["d.md"]}
    assert index.backfill_urls(lib, side, dry_run=True) == want and lib.version() == version
    assert index.backfill_urls(lib, side) == want
    for name in ("hierarchy", "vectors"):
        assert {(r.doc_id, r.source_url) for r in lib.read(name).collect()} == {("a", "https://a"), ("b", "https://b"), ("c", "https://own"), ("d", None)}
    assert index.backfill_urls(lib, side)["filled"] == 0


PAGES = "doc_id long, file_name string, source_url string, text string"


def tables(lib):
    nodes = {tuple(r) for r in lib.read("hierarchy").select("doc_id", "node_id", "level", "text", "parent_id", "prev_id", "next_id", "file_name", "header_path").collect()}
    vectors = {(r.sub_id, r.child_id, r.text, tuple(r.embedding)) for r in lib.read("vectors").collect()}
    return nodes, vectors, {tuple(r) for r in lib.read("snapshot").collect()}


def test_update_equals_a_build(spark, sf, tmp_path):
    """Two crawls of the pages: removed, altered, added, renamed and unchanged ones."""
    from corpusloom.functions import html
    from corpusloom.sources.kb import hashed_words

    pages = spark.read.parquet(f"{sf}/pages.parquet").where("page_id < 60").select(F.col("page_id").alias("doc_id"), F.concat(F.col("page_id").cast("string"), F.lit(".md")).alias("file_name"), F.col("url").alias("source_url"), html.to_markdown("html").alias("text"))
    pages = spark.createDataFrame(pages.collect(), PAGES)
    old = pages.where("doc_id % 10 <> 0")
    name = F.when(F.col("doc_id") % 13 == 0, "moved.md").otherwise(F.col("file_name"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\n\n# More\nrevised"))).otherwise(F.col("text"))
    new = pages.where("doc_id % 11 <> 0").withColumn("text", text).withColumn("file_name", name)
    lib, full = Library(spark, str(tmp_path), "inc", buckets=4), Library(spark, str(tmp_path), "full", buckets=4)
    read = spark.sparkContext.accumulator(0)

    def embed(column):
        @F.pandas_udf("int")
        def seen(x):
            read.add(len(x))
            return x.str.len()

        return F.when(seen(column) >= 0, hashed_words(column))

    assert index.update(lib, old) == {"added": old.count(), "changed": 0, "removed": 0, "unchanged": 0}
    counts = index.update(lib, new, embed)
    ids = {r.doc_id for r in new.collect()}
    was = {r.doc_id for r in old.collect()}
    changed = {d for d in ids & was if d % 7 == 0 or d % 13 == 0}
    assert counts == {"added": len(ids - was), "changed": len(changed), "removed": len(was - ids), "unchanged": len((ids & was) - changed)}
    index.build(full, new)
    assert tables(lib) == tables(full)
    fresh = full.read("vectors").where(F.col("doc_id").isin(*(changed | (ids - was)))).count()
    assert read.value == fresh < full.read("vectors").count() / 2
    version = lib.version()
    assert index.update(lib, new, embed) == {"added": 0, "changed": 0, "removed": 0, "unchanged": len(ids)}
    assert read.value == fresh and lib.version() == version and lib.status()["num_documents"] == len(ids)


def test_given_hashes(spark, tmp_path):
    """Hashes of a crawl are trusted; an unknown one means a change."""
    lib = Library(spark, str(tmp_path), "hashes", buckets=2)
    docs = lambda *rows: spark.createDataFrame(rows, f"{PAGES}, hash string")
    index.update(lib, docs((1, "a", "u", "text one", "h1"), (2, "b", "u", "text two", None)), cut=index.plain_nodes)
    got = index.update(lib, docs((1, "a", "u", "not looked at", "h1"), (2, "b", "u", "text 2", None)), cut=index.plain_nodes)
    assert got == {"added": 0, "changed": 1, "removed": 0, "unchanged": 1}
    assert {r.text for r in lib.read("hierarchy").collect()} == {"text one", "text 2"}


def test_followed_stream(spark, tmp_path):
    """Versions and removals as they come, with a stop between, lead to the build of the newest ones."""
    from corpusloom.streaming import streams

    schema = f"{PAGES}, removed boolean, at long"
    row = lambda d, text, at, removed=False: (d, f"{d}.md", "u", text, removed, at)
    lib, full = Library(spark, str(tmp_path), "inc", buckets=2), Library(spark, str(tmp_path), "full", buckets=2)
    index.build(lib, spark.createDataFrame([row(d, f"first text {d}", 0)[:4] for d in (1, 2, 3)], PAGES), cut=index.plain_nodes)
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(row(1, "second", 1), row(1, "third", 2), row(4, "new", 1))
    streams.followed(stream(), lib, f"{tmp_path}/ck", cut=index.plain_nodes).awaitTermination()
    put(row(2, None, 3, True), row(4, "newer", 3), row(3, "first text 3", 3))
    streams.followed(stream(), lib, f"{tmp_path}/ck", cut=index.plain_nodes).awaitTermination()
    index.build(full, spark.createDataFrame([row(1, "third", 0)[:4], row(3, "first text 3", 0)[:4], row(4, "newer", 0)[:4]], PAGES), cut=index.plain_nodes)
    assert tables(lib) == tables(full)


def test_gates(spark, library, tmp_path):
    def status(check, *args):
        with pytest.raises(answers.Refused) as caught:
            check(*args)
        return caught.value.status

    assert [status(answers.check_key, *a) for a in ((None, "k"), ("x", "k"), ("x", None))] == [422, 403, 500]
    assert [status(answers.check_password, *a) for a in ((None, "p"), ("x", "p"))] == [401, 403]
    answers.check_key("k", "k"), answers.check_password(None, None), answers.check_password("p", "p")
    closed = Library(spark, str(tmp_path), "closed", buckets=2)
    assert status(answers.check_access, closed, ()) == 404
    index.build(closed, spark.createDataFrame([("a", "a", "u", "# T\nbody text")], "doc_id string, file_name string, source_url string, text string"))
    answers.check_access(closed, ())
    for groups, user, code in ((["staff"], (), 403), (["staff"], ("STAFF",), None), (["Public"], (), None), (None, ("staff",), 403), ([], (), None)):
        closed.publish("access", spark.createDataFrame([(groups,)], "groups array<string>"))
        assert code is None and answers.check_access(closed, user) is None or status(answers.check_access, closed, user) == code


def test_rebuild_all(spark, tmp_path):
    docs = spark.createDataFrame([("a", "a", "u", "# T\nbody text")], "doc_id string, file_name string, source_url string, text string")
    libs = [Library(spark, str(tmp_path), n, buckets=2) for n in ("one", "bad", "out", "two")]
    pick = lambda lib: docs if lib.library_id != "bad" else docs.where("false")
    assert index.rebuild_all(libs, pick, exclude=["out"]) == {"one": "done", "bad": "failed: ValueError", "out": "excluded", "two": "done"}
    assert libs[1].status()["status"] == "failed" and "two" not in index.rebuild_all(libs, pick, stop_on_error=True)
    # a failed rebuild leaves what was there
    with pytest.raises(ValueError):
        index.build(libs[0], docs.where("false"))
    assert libs[0].read("hierarchy").count() == 2


def test_fused_with_reranker(spark):
    rows = spark.createDataFrame([("corpus", k, f"t{k}", "word " * k, float(k)) for k in range(20)], "source string, id int, title string, content string, score double")
    kb = spark.createDataFrame([("kb", 1, "t", "word " * 50, -9.0)], rows.schema)
    best = search.fused(rows, kb, scorer=lambda c: F.length(c).cast("double")).collect()
    assert len(best) == 15 and best[0].title == "[KB] t" and len(search.fused(rows, kb).collect()) == 10
    shown = search.article_results(spark.createDataFrame([("N1", "How", "text", 0.5)], "number string, title string, chunk string, score double"), "B").first()
    assert (shown.title, shown.file_type, shown.precise_content) == ("[KB] How", "kb", "text") and len(shown) == 14


def test_links_between_nodes_move_no_texts(spark):
    """Neighbours are found where a document's nodes are, and Arrow batches of whole documents are bounded."""
    docs = spark.createDataFrame([(k, "f", "u", f"# a\nline {k}\n\nmore") for k in range(5)], "doc_id long, file_name string, source_url string, text string")
    plan = index.plain_nodes(docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not any("level" in x for x in plan.split("\n") if "Exchange hashpartitioning" in x)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert index.index_nodes(docs).count() == 10
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
