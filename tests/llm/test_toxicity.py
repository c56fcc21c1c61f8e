from corpusloom.llm import queries, toxicity


def test_folding():
    for text in ("IDIOT", "1d10t", "іdіоt", "ìdíöt", "id!ot", "i.d.i.o.t", "id​iot", "ｉｄｉｏｔ", "!di0t".replace("!", "i")):
        assert toxicity.fold(text) == "idiot", text
    assert toxicity.fold("in 2024 we 7") == "in 2024 we 7"
    assert toxicity.fold("idiot! no") == "idiot! no"


def test_hits_and_exceptions():
    lex = toxicity.Lexicon({"trash": 3.0, "mor*": 2.0, "moron": 4.0, "mor": 1.0})
    hits = lambda t: sorted(lex.hits(toxicity.fold(t)).values())
    assert hits("you trash") == [3.0] and hits("the trash can is full") == [] and hits("the trash canary") == [3.0]
    assert hits("moron") == [4.0] and hits("morons") == [2.0] and hits("mor") == [1.0] and hits("armor humor") == []


def test_held_out(spark):
    """On sf0.1: the smaller table has 14 toxic held-out rows, too few to tell, some of them mislabelled."""
    sf = "/root/testdata/sf0.1"
    got = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    caught = [r.predicted for r in got if r.toxic]
    false = [r.predicted for r in got if not r.toxic]
    assert right > 0.97 and sum(caught) >= 0.9 * len(caught) and sum(false) <= 0.02 * len(false), (right, sum(caught), len(caught), sum(false))


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 11)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0)):
        lexicon = toxicity.fit(odd, lab)
        got = toxicity.score(odd, lexicon).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if not (r.text or "").strip()}) == 1
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
