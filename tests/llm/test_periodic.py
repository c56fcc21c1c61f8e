import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import periodic, queries


def plain_runs(words, least):
    """All runs, by comparing the words of every distance."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at < len(words) - q:
            end = at
            while end < len(words) - q and words[end] == words[end + q]:
                end += 1
            if end > at and end - at + q >= max(least, 2 * q):
                found.setdefault((at, end - at + q), q)
            at = max(end, at + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_kept(n, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return [k for k in range(n) if k not in gone]


words = st.integers(1, 4).flatmap(lambda k: st.lists(st.integers(0, k), max_size=40))
tailed = st.tuples(words, st.integers(0, 30), st.integers(1, 9)).map(lambda x: [x[0][k] if k < x[1] else x[0][x[1] + (k - x[1]) % x[2]] if x[1] + x[2] <= len(x[0]) else x[0][k] for k in range(len(x[0]))])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(words, tailed), max_size=4), st.sampled_from([2, 4, 5, 12]))
def test_against_all_distances(texts, least):
    got = periodic.find_runs([np.array(t, np.int64) for t in texts], least)
    for text, runs in zip(texts, got):
        assert [tuple(r) for r in runs.tolist()] == plain_runs(text, least)
        assert periodic.kept_words(len(text), runs).tolist() == plain_kept(len(text), plain_runs(text, least))


def test_steps():
    """Blocks and leftmost squares of a known sequence."""
    t = periodic.Factors(np.array([-1, 0, 1, 0, 1, 0, 1, 2, 0, 1, 0, 1, -2]))
    assert periodic.blocks(t).tolist() == [0, 1, 2, 3, 7, 8, 12]
    assert [x.tolist() for x in periodic.leftmost(t)] == [[1], [7], [2]]
    assert [x.tolist() for x in periodic.runs_of(t, 4)] == [[1, 8], [7, 12], [2, 2]]


def test_query(spark, sf, texts):
    """The whole table against a plain version of the contract."""
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert set(got) == set(texts)
    with_runs = 0
    for d, text in texts.items():
        own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(d).encode()), len(own)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = [own[k] if k < a else own[a + (k - a) % p] for k in range(n)]
        runs = {}
        for q in distances(own):
            for stretch in stretches(own, q):
                runs.setdefault(stretch, q)
        runs = sorted(((s, m, q) for (s, m), q in runs.items()), key=lambda x: (x[0], x[2]))
        r = got[d]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(own[k] for k in plain_kept(n, runs)).encode()).hexdigest()
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period, r.exponent_milli) == (*best, 1000 * best[1] // best[2] if runs else None)
        with_runs += bool(runs)
    assert with_runs > 50


def distances(own):
    """The distances at which some six words repeat: every run has such a pair, as 12 - q >= 6 or q >= 6 words are the same."""
    places, near = {}, set()
    for k in range(len(own) - 5):
        places.setdefault(tuple(own[k : k + 6]), []).append(k)
    for at in places.values():
        if len(at) * 40 > len(own):
            return range(1, len(own) // 2 + 1)
        near |= {b - a for k, a in enumerate(at) for b in at[k + 1 :] if b - a <= len(own) // 2}
    return sorted(near)


def stretches(own, q):
    same = np.array([a == b for a, b in zip(own, own[q:])], np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same, [0]])))
    return [(int(s), int(e - s + q)) for s, e in zip(edges[::2], edges[1::2]) if e - s + q >= max(12, 2 * q)]


def test_odd_rows(spark, odd, none):
    clash = odd.withColumn("runs", odd["doc_id"]).withColumn("_row", odd["doc_id"]).withColumn("_text", odd["doc_id"])
    got = periodic.periodic_runs(clash)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "kept", "value", "_row", "_text", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == odd.count()
    for r in rows:
        own = (r.text or "").split()
        runs = [tuple(x) for x in r.runs]
        if len(own) == 60_000:
            assert runs == [(0, 60_000, 1)] and r.collapsed == "word"
        else:
            assert runs == plain_runs(own, 12) and r.collapsed == " ".join(own[k] for k in plain_kept(len(own), runs))
        assert r._row == r._text == r.doc_id
    empty = periodic.periodic_runs(none)
    assert empty.count() == 0 and empty.columns[-2:] == ["runs", "collapsed"]
