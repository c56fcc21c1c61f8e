"""The similarity join of names against all pairs."""

import random

import pytest

from corpusloom.functions.fuzzy import ratio
from corpusloom.operators import names as N


def half_up(x):
    return float(int(x + 0.5))


def plain(own, targets, threshold):
    best = {}
    for a in set(own) - {None} - set(targets):
        found = [(-half_up(ratio(a, t)), t) for t in set(targets) if t is not None]
        score, target = min(found, default=(0, None))
        if -score >= threshold and target is not None:
            best[a] = (target, -score)
    return best


def pairs(spark, own, targets, threshold, **options):
    frame = lambda items: spark.createDataFrame([(i,) for i in items], "name string")
    if options:
        return {tuple(r) for r in N.similar_candidates(frame(own), frame(targets), threshold, **options).collect()}
    return {r.name: (r.target, r.score) for r in N.best_names(frame(own), frame(targets), threshold).collect()}


def slipped(rng, name):
    at = rng.randrange(len(name) + 1)
    return rng.choice((name[:at] + rng.choice("xyz ") + name[at:], name[:at] + name[at + 1 :], name[at:] + name[:at], name.upper()))


@pytest.mark.parametrize("threshold", [85, 70, 100])
def test_against_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    targets = ["".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(120)] + ["".join(rng.choices("abcdefgh .-", k=rng.randint(10, 30))) for _ in range(60)] + [None, "é€𝒳 name.pdf"]
    own = [slipped(rng, t) if rng.random() < 0.8 and t else t for t in targets * 2] + [None, ""]
    assert pairs(spark, own, targets, threshold) == plain(own, targets, threshold)


def test_parts(spark, sf):
    """Part names with slips: the join finds what all pairs give, from few candidates."""
    rng = random.Random(1)
    targets = [r.p_name for r in spark.read.parquet(f"{sf}/part.parquet").select("p_name").orderBy("p_partkey").limit(500).collect()]
    own = [slipped(rng, t) + rng.choice(("", ".pdf")) for t in targets]
    assert pairs(spark, own, targets, 85) == plain(own, targets, 85)
    found = pairs(spark, own, targets, 85, block=16)
    assert found == pairs(spark, own, targets, 85, block=10_000)
    least = {(a, t) for a in set(own) for t in set(targets) if ratio(a, t) >= 84.5}
    assert least <= found and len(found) < 0.02 * len(set(own)) * len(set(targets))


def test_nothing_is_broadcast(spark):
    """Names and their grams don't pass through the driver."""
    frame = spark.createDataFrame([(f"name {k}.md",) for k in range(50)], "name string")
    df = N.best_names(frame.selectExpr("concat(name, 'x') as name"), frame)
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def similar(own, targets, twice):
    return {(i, k) for i, a in enumerate(own) for k, t in enumerate(targets) if ratio(a, t) >= twice / 2}


@pytest.mark.parametrize(("m", "letters"), [(31, "0123456789abcdef"), (17, "é€𝒳abc"), (70, "abcdefgh")])
def test_pieces_against_all_pairs(monkeypatch, m, letters):
    """Names that meet by rests of pieces are those that all pairs give, for every weight."""
    rng = random.Random(m)
    targets = sorted({"".join(rng.choices(letters, k=m - 3)) + ".md" for _ in range(120)})
    own = [rng.choice(targets) for _ in range(120)]
    for _ in range(m // 4):
        own = [slipped(rng, name) if rng.random() < 0.5 else name for name in own]
    own = sorted({*own, "", "zz"})
    expected = similar(own, targets, 169)
    monkeypatch.setattr(N, "DIRECT", 0)
    monkeypatch.setattr(N, "_cost", lambda n, m: 1e6)
    for weight in N.WEIGHTS:
        monkeypatch.setattr(N, "WEIGHTS", (weight,))
        assert set(zip(*(z.tolist() for z in N.similar_pairs(own, targets, 169, False)))) == expected


def test_random_names_meet_no_others(spark):
    """Only similar names are handed on: pairs with common grams alone grow with the square of the names."""
    rng = random.Random(2)
    targets = ["".join(rng.choices("0123456789abcdef", k=28)) + ".md" for _ in range(400)]
    own = [t[:5] + "~" + t[6:] + ".pdf" for t in targets]
    found = pairs(spark, own, targets, 85, block=128)
    assert found == {(own[i], targets[k]) for i, k in similar(own, targets, 169)} and len(found) == 400
