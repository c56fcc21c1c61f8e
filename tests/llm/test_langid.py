from pyspark.sql import functions as F

from corpusloom.llm import langid, queries


def test_held_out(spark, sf):
    got = queries.op3_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang_pred == r.lang for r in got) / len(got)
    assert right > 0.95, right
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(odd, none):
    got = langid.identify(odd, odd.where("lang is not null"))
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.count() == odd.count()
    assert by[(1, None)].lang_pred == "und" and by[(2, "")].score == 0
    assert {r.lang_pred for r in got.collect()} <= {"en", "fr", "de", "und"}
    assert langid.identify(none, none).count() == 0
    assert langid.identify(odd, none).where("lang_pred <> 'und'").count() == 0


def test_counts_in_pieces():
    text = "ab cd " * 400_000
    whole = langid.ngram_counts(text)
    raw = b" " + b" ".join(text.encode().split()) + b" "
    assert int(whole.sum()) == sum(len(raw) - n + 1 for n in range(1, 5))


def test_rejection(spark):
    rows = [(k, t, lang) for k in range(40) for t, lang in ((f"the cat and the dog ran over there {k}", "en"), (f"le chat est dans la maison avec nous {k}", "fr"))]
    train = spark.createDataFrame([(2 * i, *r[1:]) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "the dog and the cat"), (2, "zzxq qqvw kkjh wwxz")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(docs, train).collect()}
    assert got[1].lang_pred == "en" and got[2].rejected and not langid.identify(train, train).where(F.col("rejected")).count() > 8
