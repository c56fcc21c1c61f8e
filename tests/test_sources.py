"""Sources, stores and streams against small trees."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import filters
from corpusloom.sources import docstore, files, kb, store
from corpusloom.streaming import streams


@pytest.fixture
def tree(tmp_path):
    for path, content in {
        "a/guide.pdf": PDF, "a/bad.pdf": b"<html>", "b/Guide.html": b"<p>x</p>", "b/metadata.json": b"{}", "b/page.html": b"x", "c/old.doc": b"x", "c/slides.PPTX": b"x",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    return str(tmp_path)

PDF = b"%PDF-1.7 1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj 3 0 obj << /Type /Page >> endobj"


def test_scan_and_validate(spark, tree):
    rows = {r.path: r for r in files.validated(files.scan_sources(spark, tree, content=True)).collect()}
    assert set(rows) == {"a/guide.pdf", "a/bad.pdf", "b/Guide.html", "c/slides.PPTX"}
    assert rows["a/bad.pdf"].reject_reason == "invalid_pdf_signature" and rows["a/guide.pdf"].reject_reason is None
    with pytest.raises(ValueError):
        files.require_files(files.scan_sources(spark, tree, ("xyz",)))
    hit = files.served(files.scan_sources(spark, tree), "x/guide.docx").first()
    assert hit.path == "a/guide.pdf" and hit.mime == "application/pdf"
    assert files.served(files.scan_sources(spark, tree), "../guide.pdf").count() == 0


def test_markdown_and_sidecars(spark, tmp_path):
    for path, content in {"x/a.md": "A", "y/b.md": "B", "z/c.md": "C", "x/a.md.meta": json.dumps({"source_url": "u-a"}), "w/b.md.meta": json.dumps({"source_url": "u-b"})}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(content)
    docs = files.with_sidecars(files.scan_markdown(spark, str(tmp_path)), files.scan_sidecars(spark, str(tmp_path)))
    assert {r.path: r.source_url for r in docs.collect()} == {"x/a.md": "u-a", "y/b.md": "u-b", "z/c.md": None}


def test_missing_and_convert(spark, tree, tmp_path):
    sources = files.scan_sources(spark, tree, content=True)
    done = spark.createDataFrame([("a/guide.md",)], "path string")
    assert {r.path for r in files.missing_conversions(sources, done).collect()} == {"a/bad.pdf", "b/Guide.html", "c/slides.PPTX"}

    def convert(content, ext):
        if ext == "pptx":
            raise OSError("no")
        return "# some Markdown" if ext == "pdf" else "x"

    got = {r.path: r.outcome for r in files.converted(sources, convert, spark.createDataFrame([("a/bad.pdf",)], "path string")).collect()}
    assert got == {"a/guide.pdf": "converted", "b/Guide.html": "too short", "c/slides.PPTX": "failed: OSError"}


def test_page_metadata(spark, tmp_path):
    for k, title in ((1, "old"), (2, "new")):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "metadata.json").write_text(json.dumps({"url": "http://u", "title": title, "htmlLinks": [{"url": "l", "text": "t"}]}))
    assert [r.title for r in files.scan_page_metadata(spark, str(tmp_path)).collect()] == ["new"]


def test_store(spark, tmp_path):
    lib = store.Library(spark, str(tmp_path), "lib-1", buckets=2)
    assert lib.status()["status"] == "not_found" and lib.count() == 0
    pairs = lambda *p: spark.createDataFrame(list(p), "key string, value string")
    lib.put_all(pairs(("a", "1"), ("b", "2")))
    lib.put_all(pairs(("b", "3"), ("c", "4")))
    assert {r.key: r.value for r in lib.get_all().collect()} == {"a": "1", "b": "3", "c": "4"} and lib.get("z") is None
    assert lib.delete("a") and not lib.delete("a") and lib.count() == 2
    with pytest.raises(ValueError):
        lib.publish("nodes", pairs(("x", "1")), least=10)
    assert lib.count() == 2
    lib.set_status("indexing")
    lib.set_status("done", num_documents=2)
    assert lib.status()["status"] == "done" and lib.status()["num_documents"] == 2
    with pytest.raises(ValueError):
        store.Library(spark, str(tmp_path), "../x")


def test_migration(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"docstore/data": {"n1": {"text": "a"}, "n2": {"text": "b"}}}))
    (tmp_path / "bad.json").write_text("{")
    lib = store.Library(spark, str(tmp_path / "l"), "m", buckets=2)
    run = lambda name, **k: docstore.migrate_docstore(spark, str(tmp_path / name), lib, **k)["status"]
    assert run("none.json") == "no_json" and run("bad.json") == "corrupted_json" and run("d.json", dry_run=True) == "dry_run"
    assert run("d.json") == "success" and run("d.json") == "already_migrated" and json.loads(lib.get("n1"))["text"] == "a"


def test_migration_of_wrapped_nodes(spark, tmp_path):
    """Splits within a file, strings that look like keys, all collections, node types, statuses."""
    odd = 'a "__data__": {"x"} and \\"__type__\\": "1"}, "k": { \n é 😀 ' + "long " * 3000
    node = lambda k, up: {"__data__": {"id_": k, "text": f"{k} {odd}", "metadata": {}, "relationships": {"4": {"node_id": up}} if up else {}}, "__type__": "1"}
    nodes = {f"p{k}": node(f"p{k}", None) for k in range(3)} | {f'c"{k}': node(f'c"{k}', f"p{k % 3}") for k in range(20)} | {f"s{k}": node(f"s{k}", f'c"{k % 20}') for k in range(40)}
    whole = {"docstore/metadata": {"p0": {"doc_hash": "x"}}, "docstore/data": nodes, "docstore/ref_doc_info": {"d1": {"node_ids": ["p0"]}, "d2": {"node_ids": []}}}
    (tmp_path / "s.json").write_text(json.dumps(whole), encoding="utf-8")
    lib = store.Library(spark, str(tmp_path / "l"), "m", buckets=4)
    run = lambda name, **k: docstore.migrate_docstore(spark, str(tmp_path / name), lib, **k)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")  # many splits of the one file
    try:
        assert docstore._records(spark, str(tmp_path / "s.json")).rdd.getNumPartitions() > 5
        counts = {"nodes": 63, "parent_nodes": 3, "child_nodes": 20, "subchunks": 40, "ref_doc_entries": 2, "metadata_entries": 1}
        got = run("s.json", backup=True)
        assert got["status"] == "success" and {k: got[k] for k in counts} == counts
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.key: json.loads(r.value) for r in lib.get_all().collect()} == nodes
    assert json.loads(lib.get("p0", "metadata")) == {"doc_hash": "x"} and lib.count("ref_docs") == 2
    assert not (tmp_path / "s.json").exists() and run("s.json")["status"] == "already_migrated"
    assert run("s.json", force=True)["status"] == "success"
    text = json.dumps(whole)
    for name, bad in (("cut.json", text[:-1]), ("half.json", text[: len(text) // 2]), ("key.json", text.replace('"p1": {"__data__"', '"other": {"__data__"'))):
        (tmp_path / name).write_text(bad)
        assert run(name, force=True)["status"] == "corrupted_json", name
    fresh = store.Library(spark, str(tmp_path / "f"), "m")
    fresh.keyed = lambda name: (_ for _ in ()).throw(OSError("disk"))
    assert docstore.migrate_docstore(spark, str(tmp_path / "s.json"), fresh)["status"] == "write_error" and not fresh._current("nodes")


def test_knowledge_base(spark):
    def fetch(base, offset, size):
        if base == "k2" and offset:
            raise OSError
        rows = [{"sys_id": f"{base}-{k}", "number": {"display_value": f"N{k}"}, "short_description": "T", "text": "<h1>A</h1><p>word</p>", "kb_category": {"display_value": "My Cat!"}} for k in range(150)]
        return rows[offset : offset + size]

    got = kb.articles(spark, fetch, "['k1', 'k2']")
    assert {r[0]: r[1] for r in got.groupBy(F.substring("sys_id", 1, 2)).count().collect()} == {"k1": 150, "k2": 100}
    doc = kb.to_markdown(got).where("sys_id = 'k1-3'").first()
    assert doc.path == "My_Cat/N3.md" and doc.markdown == "# T\n\nReference: N3\n\n# A\n\nword"
    assert kb.catalogue(spark, lambda n: 1 / 0).count() == 0
    found = got.where("sys_id like 'k1%'").select("number", F.col("short_description").alias("title"), F.col("text").alias("html"))
    assert kb.live_search(found, "the word", top_k=3).count() == 3


def test_articles_as_a_stream(spark, sf, tmp_path):
    """Two pulls over conversations as articles: each comes once; a window that breaks off is told and pulled again."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("concat(conv_id, '-', turn) AS id", "text", "conv_id % 2 AS base").collect()
    service = [{"sys_id": r.id, "number": {"display_value": r.id}, "text": r.text, "sys_updated_on": f"2024-01-{1 + k % 28:02d}", "base": f"k{r.base}"} for k, r in enumerate(turns)]
    upto = tmp_path / "newest"

    def fetch(base, after, until, offset, size, broken=None):
        rows = sorted((r for r in service if r["base"] == base and after < r["sys_updated_on"] <= until), key=lambda r: (r["sys_updated_on"], r["sys_id"]))
        if broken and base == "k1" and offset >= 100:
            raise TimeoutError
        return rows[offset : offset + size]

    def newest(base):
        if base == "gone":
            raise OSError
        return upto.read_text()

    def pull(call):
        stream = kb.article_changes(spark, call, newest, "['k0', 'k1', 'gone']")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return spark.read.schema(kb.CHANGES).parquet(f"{tmp_path}/out")

    upto.write_text("2024-01-10")
    first = pull(fetch).collect()
    assert {r.sys_id for r in first} == {r["sys_id"] for r in service if r["sys_updated_on"] <= "2024-01-10"} and len(first) == len({r.sys_id for r in first})
    upto.write_text("2024-01-28")
    both = pull(lambda *a: fetch(*a, broken=True))
    (error,) = both.where("error is not null").collect()
    assert (error.base, error.error, error.after, error.upto, error.skip) == ("k1", "TimeoutError", "2024-01-10", "2024-01-28", 100)
    rest = kb.pulled_again(spark, fetch, both)
    ids = [r.sys_id for r in both.where("error is null").unionByName(rest).collect()]
    assert sorted(ids) == sorted(r["sys_id"] for r in service)
    assert pull(fetch).count() == both.count() and kb.pulled_again(spark, fetch, rest).count() == 0


def test_live_fetch(spark):
    found = kb.found_live(spark, lambda words, n: (200, [{"sys_id": words, "number": {"value": str(k)}} for k in range(20)]), "where is the printer")
    assert found.count() == 10 and "printer" in found.first().sys_id.lower()
    with pytest.raises(ConnectionError, match="503"):
        kb.found_live(spark, lambda words, n: (503, []), "printer")


def test_toc_classifier(spark):
    nodes = spark.createDataFrame([(1, "a | b"), (2, "plain text"), (3, "contents here"), (4, "x | y")], "id int, text string")
    verdict = lambda c: F.when(c.contains("a |"), True).when(c.contains("x |"), None).otherwise(False)
    assert [r.id for r in filters.without_toc(nodes, verdict).orderBy("id").collect()] == [2, 3, 4]
    assert filters.without_toc(nodes).count() == 4


def test_streams(spark, tmp_path, sf):
    docs = spark.range(5).select(F.col("id").cast("string").alias("path"), F.lit("t").alias("text"))
    docs.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        streams.indexed(streams.new_documents(spark, f"{tmp_path}/in"), lambda d: d.withColumn("n", F.length("text")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = streams.request_windows(events).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == 10_000


def test_stores_are_read_once(spark, tmp_path):
    """After the first reading nodes, links and the other collections come from the staged table, source files or not."""
    from corpusloom.sources import docstore

    nodes = {f"n{k}": {"__data__": {"id_": f"n{k}", "text": "a, \n " * k, "relationships": {"4": {"node_id": "n0"}} if k else {}}, "__type__": "1"} for k in range(4)}
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"docstore/metadata": {"n0": {"x": 1}}, "docstore/data": nodes, "docstore/ref_doc_info": {}}, indent=90))
    found, rest = docstore._read(spark, str(path), str(tmp_path / "staged"))
    path.unlink()
    assert {r.key: r.parent for r in found.collect()} == {"n0": None, "n1": "n0", "n2": "n0", "n3": "n0"}
    assert {r.key: json.loads(r.value) for r in found.collect()} == nodes
    assert [r.key for r in docstore._entries(rest, docstore.METADATA).collect()] == ["n0"]
