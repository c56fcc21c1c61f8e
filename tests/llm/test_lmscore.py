import math
from collections import Counter, defaultdict

import numpy as np

from corpusloom.llm import lmscore, queries


def brute(rows):
    """Losses by dictionaries, from (text, fold, part) rows: models of a fold are counted on the other one."""
    pad = [""] * (lmscore.ORDER - 1)
    seqs = [pad + list((t or "").lower()) for t, _, _ in rows]
    symbols = len({c for s in seqs for c in s[lmscore.ORDER - 1 :]}) + 1
    counts, contexts = defaultdict(Counter), defaultdict(Counter)
    for s, (_, fold, part) in zip(seqs, rows):
        if part:
            for k in range(lmscore.ORDER - 1, len(s)):
                for n in range(1, lmscore.ORDER + 1):
                    g = tuple(s[k - n + 1 : k + 1])
                    counts[1 - fold, part][g] += 1
                    contexts[1 - fold, part][g[:-1]] += 1
    out = []
    for s, (_, fold, _) in zip(seqs, rows):
        loss = []
        for part in (1, 2):
            c, x, total = counts[fold, part], contexts[fold, part], 0.0
            for k in range(lmscore.ORDER - 1, len(s)):
                p = 1 / (symbols + 1)
                for n in range(1, lmscore.ORDER + 1):
                    g = tuple(s[k - n + 1 : k + 1])
                    # contexts of n - 1 tokens are told apart by length
                    p = (c[g] + lmscore.A * p) / (x[g[:-1]] + lmscore.A)
                total -= math.log(p)
            loss.append(total / max(1, len(s) - lmscore.ORDER + 1))
        out.append((len(s) - lmscore.ORDER + 1, *loss))
    return out


def test_against_dictionaries(spark, texts):
    """Whole texts, exact counts, on either way of looking n-grams up."""
    docs = {d: texts[d] for d in sorted(texts)[:40]} | {5000: None, 5001: "", 5002: "漢字かな交じり文 και ελληνικά " * 5}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    target = spark.createDataFrame([(d,) for d in docs if d % 3 == 0], "doc_id long")
    rows = {r.doc_id: (r.text, r.fold, r.part) for r in lmscore.sampled(df, target).collect()}
    assert {r[2] for r in rows.values()} == {0, 1, 2} and {r[1] for r in rows.values()} == {0, 1}
    for fold in (0, 1):
        sizes = [sum(len(t or "") for t, f, p in rows.values() if p == k and f == fold) for k in (1, 2)]
        assert abs(sizes[1] - sizes[0]) < max(len(t or "") for t, _, _ in rows.values())
    want = dict(zip(rows, brute(rows.values())))
    for few in (lmscore.FEW_GRAMS, 0):
        got = {r.doc_id: r for r in lmscore.cross_entropy_difference(df, target, few).collect()}
        for d, (n, t, b) in want.items():
            assert got[d].n_tokens == n and abs(got[d].target_loss - t) < 1e-9 and abs(got[d].background_loss - b) < 1e-9
            assert abs(got[d].score - (t - b)) < 1e-9


def test_samples_by_running_sums(spark):
    """Rows in the order of the hash up to the one that reaches the number, against plain running sums; copies of a long text don't empty a sample."""
    rows = [(k, "one long text that very many rows repeat " * 40) for k in range(50)] + [(50 + k, f"row {k} says this " * (1 + k % 5)) for k in range(100)] + [(None, "no id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for target in (list(range(50, 60)), list(range(60)), [7]):
        got = lmscore.sampled(df, spark.createDataFrame([(d,) for d in target], "doc_id long"))
        got = got.withColumn("h", lmscore.F.xxhash64(lmscore.F.lit(1), lmscore.F.col("doc_id").cast("string"), "text")).collect()
        assert len(got) == len(rows)
        for fold in (0, 1):
            side = {own: sorted((r.h, len(r.text), r.part) for r in got if r.fold == fold and (r.doc_id in target) == own) for own in (True, False)}
            total = {own: sum(n for _, n, _ in held) for own, held in side.items()}
            most = min(total.values())
            for own, held in side.items():
                run, want = 0, set()
                for h, n, _ in held:
                    if not most or run < most:
                        want.add(h)
                    run += n
                assert [bool(p) for _, _, p in held] == [h in want for h, _, _ in held]
                assert all(p in (0, 1 if own else 2) for _, _, p in held) and (not held or want)
    scored = lmscore.cross_entropy_difference(df, spark.createDataFrame([(d,) for d in range(50, 60)], "doc_id long")).collect()
    assert len({round(r.background_loss, 6) for r in scored}) > 10


def test_target_scores_lower(spark):
    """Rows of the target's kind that were no part of it score lower than others."""
    kinds = ("the cat sat on the mat and saw a rat", "zwölf boxkämpfer jagen viktor quer über den deich")
    rows = [(k, " ".join(kinds[k % 2].split()[j % 7 :] * 4) + f" {k}") for k, j in zip(range(120), range(3, 123))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lmscore.cross_entropy_difference(df, df.where("doc_id % 2 = 0 and doc_id < 60").select("doc_id")).collect()
    held = [r for r in got if r.doc_id >= 60]
    assert max(r.score for r in held if r.doc_id % 2 == 0) < min(r.score for r in held if r.doc_id % 2)


def test_grams_in_pieces(monkeypatch):
    table = lmscore.symbol_table(np.array(sorted(map(ord, "abcdefgh ")), np.uint32))
    whole = np.concatenate(list(lmscore.grams("abc def gh " * 50, table)))
    monkeypatch.setattr(lmscore, "_PIECE", 7)
    assert (whole == np.concatenate(list(lmscore.grams("abc def gh " * 50, table)))).all() and len(set(whole.tolist())) == 14


def test_query(spark, sf, texts):
    df = queries.op8_lm_score(spark, sf)
    got = df.collect()
    assert df.columns == ["doc_id", *lmscore.RESULTS]
    assert len(got) == len(texts) and all(r.n_tokens == len((texts[r.doc_id] or "").lower()) for r in got)


def test_odd_rows(spark, odd, none):
    target = spark.createDataFrame([(1,), (9,), (9,), (None,)], "doc_id long")
    got = lmscore.cross_entropy_difference(odd.withColumns({c: lmscore.F.lit(4) for c in ("_lm_fold", "_lm_sums", "fold", "gram", "n", "n_tokens")}), target).collect()
    assert len(got) == odd.count() and all(r._lm_fold == r.gram == r.n == 4 for r in got)
    assert all(r.score == r.target_loss == 0 and r.n_tokens == 0 for r in got if not r.text)
    alike = defaultdict(set)
    for r in got:
        alike[r.text].add(r.score)
    assert all(len(s) == 1 for s in alike.values())
    for few in (0, 10_000):
        assert lmscore.cross_entropy_difference(odd, target.limit(0), few).count() == odd.count()
        assert lmscore.cross_entropy_difference(none, target, few).count() == 0
