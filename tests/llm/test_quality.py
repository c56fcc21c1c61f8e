import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import quality, queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {j for k in range(len(words) - 2) if wins[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_and_base(spark, sf, texts):
    got = queries.op10_quality_rules(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert tuple(r[c] for c in quality.COUNTS) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_verdict_on_rows_outside_the_fit(spark):
    """Thresholds from half of the labelled rows, figures from the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fitted = labels.where("crc32(cast(doc_id as string)) % 2 = 0")
    got = quality.judge(docs.select("doc_id", "text"), fitted).join(labels.join(fitted, "doc_id", "left_anti"), "doc_id").where("not base_failed").collect()
    good, bad = ([r for r in got if r.quality == q] for q in (1, 0))
    assert len(bad) > 100 and sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.05 * len(bad)
    assert all((r.anomaly <= 1) == r.kept and (r.rule is None) == (r.anomaly == 0) for r in got)


def test_windows_brute():
    for text in ("a b c a b c", "a b c d", "a a a a", "", "a b", "x y z " * 50 + "q"):
        assert quality.rule_counts(text)[:5] == brute(text)
    words = [b"%d" % (k % 7) for k in range(100)]
    assert quality.repeated_in_windows(words)[0] == 100


def brute_depth(value, rows, rng, depth=0):
    """Path length of one value, walking down as the tree is grown."""
    if depth == quality.HEIGHT or min(rows) == max(rows):
        return depth + quality.expected_depth(len(rows))
    at = max(rng.uniform(min(rows), max(rows)), np.nextafter(min(rows), max(rows)))
    left, right = [r for r in rows if r < at], [r for r in rows if r >= at]
    # the tree draws for its left part first
    if value < at:
        return brute_depth(value, left, rng, depth + 1)
    skip(left, rng, depth + 1)
    return brute_depth(value, right, rng, depth + 1)


def skip(rows, rng, depth):
    if depth < quality.HEIGHT and min(rows) < max(rows):
        at = max(rng.uniform(min(rows), max(rows)), np.nextafter(min(rows), max(rows)))
        skip([r for r in rows if r < at], rng, depth + 1)
        skip([r for r in rows if r >= at], rng, depth + 1)


def test_forest_against_brute_force(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 1)
    values = np.random.default_rng(1).random(60)
    forest = quality.IsolationForest(values, np.random.default_rng(5))
    for v in (*values[:10], -1.0, 2.0, 0.5):
        rng = np.random.default_rng(5)
        own = values[rng.permutation(60)].tolist()
        assert abs(forest.score(np.array([v]))[0] - 2.0 ** (-brute_depth(v, own, rng) / quality.expected_depth(quality.SUBSAMPLE))) < 1e-12


def test_forest_isolates():
    rng = np.random.default_rng(0)
    normal = rng.random(5000) * 0.02
    normal[:5] = 0.9
    forest = quality.IsolationForest(normal, rng)
    assert forest.score(np.array([0.9, 5.0])).min() > np.quantile(forest.score(normal), 0.99)
    assert len(set(forest.score(np.array([0.001, 0.01, 0.02])))) > 1  # ordinary values are told apart as well
    same = quality.IsolationForest(np.ones(300), rng)
    assert len(set(same.score(np.array([0.0, 1.0, 2.0])))) == 1


def test_clashing_names(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    more = odd.limit(1).withColumns({"doc_id": F.lit(77).cast("long"), "text": F.lit(" ".join(f"word{k}" for k in range(99)))})
    df = odd.unionByName(more).withColumns({c: F.lit(f"own {c}") for c in (*quality.COUNTS, "anomaly", "rule", "base_failed", "kept", "_rules", "rules", "quality")})
    judged = quality.judge(df, labels).collect()
    got = quality.accepted(df, labels).collect()
    assert len(got) == sum(r.kept for r in judged) > 0 and all(r.kept == "own kept" and r.n_words == "own n_words" and r._rules == "own _rules" for r in got)
    assert all(isinstance(r.kept, bool) and r._rules == "own _rules" for r in judged)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    got = quality.judge(odd, labels).collect()
    assert len(got) == odd.count()
    assert all(not r.kept for r in got if not (r.text or "").strip())
    assert quality.judge(none, labels.limit(0)).count() == 0
    assert {r.doc_id for r in quality.judge(odd, labels.limit(0)).where("kept").collect()} == set()


def test_all_rows_take_part_in_the_fit(spark):
    """Counts of every document and every labelled row make the model, whatever their number."""
    rows = [(k, " ".join(f"w{j}" for j in range(60 + k % 40)) + (" # #" * 20 if k % 10 == 0 else "")) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 10 > 0), 0) for k in range(400)], "doc_id long, quality int, toxic int")
    seen = []
    plain = quality._by_step
    quality._by_step = lambda *x: seen.append(plain(*x)) or seen[-1]
    try:
        model = quality.fit(docs, labels, F.lit(False))
    finally:
        quality._by_step = plain
    assert all(own[:, 1].sum() == 400 for own in seen[0].values()) and all(own[:, 1].sum() == 400 for own in seen[1].values())
    assert len(seen[0]) == len(quality.RULES) and all(own[:, 1].sum() == 360 for own in seen[2].values())
    assert model.cuts
    got = quality.judge(docs, labels).collect()
    assert all(r.kept == (r.doc_id % 10 > 0) for r in got if not r.base_failed)


def test_steps():
    values = np.array([0.0, 1e-6, 0.25, 0.2501, 0.5, 1.0, 3.7, 1e5])
    own = quality.steps(values)
    assert (np.diff(own) >= 0).all() and own[0] == 0
    low = quality.from_steps(own)
    assert (low <= values).all() and (values - low <= values / quality.STEPS).all()
