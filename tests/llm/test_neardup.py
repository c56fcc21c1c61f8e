import random
import re
from collections import defaultdict

import pytest

from corpusloom.llm import neardup, queries


def brute(rows, n, pct):
    """n_shingles, component and links of every id, from all pairs that share a shingle."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    tried = set()
    for d, s in sets.items():
        for x in s:
            for e in index[x]:
                if e > d and (d, e) not in tried:
                    tried.add((d, e))
                    both = len(s & sets[e])
                    if 100 * both >= pct * (len(s) + len(sets[e]) - both):
                        a, b = sorted((find(d), find(e)))
                        parent[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_against_all_pairs(spark, sf, texts):
    want = brute(texts.items(), 3, 85)
    got = queries.op6_near_duplicates(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_chain_and_crowd(spark, seed):
    """A crowd around one text, most of it unlinked with each other, and a chain that only neighbours link."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(120)]
    rows = [(500, " ".join(base))]
    for k in range(60):
        w = list(base)
        for p in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            w[p] = word()
        rows.append((1000 + k, " ".join(w)))
    chain = [word() for _ in range(150)]
    for k in range(12):
        chain = chain[4:] + [word() for _ in range(4)]
        rows.append((2000 + k, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, pct in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, n, pct).collect()}
        assert got == brute(rows, n, pct)


def test_odd_rows(odd, none):
    got = neardup.near_duplicates(odd, 3, 85)
    by = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
    assert got.count() == odd.count()
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[3].component_id == 3 and by[3].kept
    assert by[4].n_shingles == 1 and by[10].component_id == 9 and not by[10].kept
    assert by[5].n_shingles == 1 and by[7].n_shingles == 1
    assert neardup.near_duplicates(none).count() == 0
    left = neardup.deduplicated(odd, 3, 85)
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [1, 2, 3, 4, 4, 5, 6, 7, 8, 9]


def test_bands():
    m = neardup.bands(0.85)
    assert 2 * (1 - 0.85**neardup.ROWS) ** m <= neardup.MISS
