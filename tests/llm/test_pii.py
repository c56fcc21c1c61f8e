import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def brute(text):
    out = []
    for kind, rx in PLAIN.items():
        for m in re.finditer(rx, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), list(PLAIN).index(kind), m.end(), kind))
    return sorted(out)


def listing(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def check(rows, got):
    assert len(got) == len(rows)
    for (d, t), r in zip(sorted(rows), sorted(got, key=lambda r: r.doc_id)):
        want = brute(t)
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[3] == k for x in want) for k in PLAIN], (t, r)
        assert r.base_sha256 == hashlib.sha256(listing(want).encode()).hexdigest(), (t, listing(want), r.spans)
        assert [s for s in r.spans.split(",") if s and not s.startswith(("term", "secret"))] == [s for s in listing(want).split(",") if s]


def test_documents(spark, sf, texts):
    check(list(texts.items()), queries.op4_private_data(spark, sf).collect())


def test_hard_cases(spark):
    rows = [
        "a@b.c@d.e", "a@b.c_d@e.f x", "é a.b@c-d.org, 😀 1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004 1.2.3", "4111 1111 1111 1111-", "4111-1111-1111-1111 4111111111111112",
        "+1 (212) 555-0100. +12 34", "+1234567890123456", "0" * 40, "1.1.1.1.", "x@y.z." * 30, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "+41 44 668 18 00 and +1-212-555-0100 me@here.org 10.0.0.1",
        "", None, "a" * 20_000, "1 " * 100_000, "1." * 100_000, "+1(" * 50_000,
    ]
    rows = list(enumerate(rows))
    check(rows, pii.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_random_texts(spark):
    found = []

    @settings(max_examples=400, deadline=None, derandomize=True)
    @given(st.text(alphabet="a@.-_%+ 0123456789()é\n4", max_size=60))
    def gather(t):
        found.append(t)

    gather()
    rows = list(enumerate(dict.fromkeys(found)))
    check(rows, pii.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def corpus(*more):
    """Two hundred plain texts and some more, as rows."""
    rows = [(k, f"plain words stand here in number {k} and nothing else") for k in range(200)]
    return rows + [(1000 + k, t) for k, t in enumerate(more)]


def found(spark, rows):
    return {r.doc_id: r for r in pii.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_disclosing_terms(spark):
    rows = corpus("plain words by Zebulon at zeb@x.org stand here and nothing else", "here Zebulon stands, zeb@x.org and nothing else")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(spark, rows)
    assert got[5].spans == "" and got[1000].n_email == 1
    assert got[1000].spans == "term:15:22,email:26:35" and got[1001].spans == "term:5:12,email:21:30"
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert clean[1000] == "plain words by <removed> at <email> stand here and nothing else" and clean[5] == rows[5][1]


def test_rare_words_disclose_nothing(spark):
    got = found(spark, corpus("please reply quickly regarding kitchens to zeb@x.org thanks"))
    assert got[1000].spans == "email:43:52" and got[1000].n_spans == 1


def test_whole_texts_and_other_texts(spark):
    """A name is found far from its address, and in a text without it; neither makes the others drop out."""
    filler = " plain words stand here and nothing else" * 6
    rows = corpus(f"Zebulon wrote.{filler} ask zeb@x.org", f"mail zeb@x.org{filler} says Zebulon himself", "we met Zebulon today")
    got = found(spark, rows)
    assert got[1000].spans.startswith("term:0:7,") and got[1000].n_terms == 1
    assert got[1001].n_terms == 1 and got[1002].spans == "term:7:14"


def test_repeated_rows_change_nothing(spark):
    texts = ["plain words by Zebulon at zeb@x.org stand", "here Zebulon stands, zeb@x.org and more", "nothing but zeb@x.org alone"]
    want = {t: r.spans for t, r in zip(texts, (v for k, v in sorted(found(spark, corpus(*texts)).items()) if k >= 1000))}
    assert any("term" in s for s in want.values())
    rows = corpus(*[t for k, t in enumerate(texts) for _ in range((1, 5, 40)[k])])
    got = found(spark, rows)
    assert all(got[d].spans == want.get(t, "") for d, t in rows)


def test_variants_of_a_text_are_no_evidence(spark):
    letters = "bcdfghklmnprstvz"
    rare = " ".join(f"{a}{b}{c}o" for a in letters[:5] for b in letters[5:10] for c in "ae")
    got = found(spark, corpus(f"one {rare} zeb@x.org end", f"two {rare} zeb@x.org end"))
    assert got[1000].n_terms == got[1001].n_terms == 0


def test_secrets(spark):
    rows = [(1, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" thus'), (2, "a_very_long_identifier_of_2024 x1234567890123456789012"), (3, "aaaaaaaaaaaaaaaaaaaaaaaaaa1"), (4, "k9aB3xQ7zP1mN5vT8wR2@x.org")]
    got = found(spark, rows)
    assert got[1].spans == "secret:9:49" and got[1].n_secrets == 1 and got[2].n_spans == got[3].n_spans == 0 and got[4].spans == "email:0:26"


def test_statistics_against_brute_force(spark, texts):
    """Terms and their disclosure over whole texts, counted with dictionaries."""
    import math
    from collections import Counter, defaultdict

    import regex

    rows = [(d, t) for d, t in sorted(texts.items())[:300]] + [(10_000 + k, f"{t} Zebulon Quill, {'zeb@x.org' if k % 3 else 'ann@y.org'}") for k, t in enumerate(sorted(texts.values())[40:52])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    base = df.select("doc_id", pii.F.xxhash64("text").alias("h"), "text")
    matched = pii._matched(base)
    got = {r.term: r.disclosure for r in pii.disclosing_terms(base, matched, pii._entities(matched)).collect()}
    all_texts = {t for _, t in rows}
    terms = {t: {w.lower() for w in regex.findall(r"[\p{L}\p{N}][\p{L}\p{N}_'\-]*+", t)} for t in all_texts}
    df_t = Counter(w for t in all_texts for w in terms[t])
    holds = defaultdict(set)
    for t in all_texts:
        for _, kind, end, name in brute(t):
            start = _
            holds[(name, t[start:end].lower())].add(t)
        for m in regex.finditer(r"(?<![A-Za-z0-9_+])[A-Za-z0-9_+]{20,}", t):
            holds[("secret", m[0].lower())].add(t)
    want, n = {}, len(all_texts)
    for own in holds.values():
        if len(own) < pii.SUPPORT:
            continue
        df_et = Counter(w for t in own for w in terms[t])
        one = {w: math.log(n * (c - pii.SHRINK) / (len(own) * df_t[w])) / math.log(n / len(own)) for w, c in df_et.items() if c >= pii.SUPPORT}
        one = {w: min(1.0, x) for w, x in one.items() if x >= pii.GENERALISE}
        if len(one) <= pii.FEW or len(one) <= pii.VARIANT * sum(len(terms[t]) for t in own) / len(own):
            for w, x in one.items():
                want[w] = max(want.get(w, 0.0), x)
    assert set(got) == set(want) and "quill" in got and all(abs(got[w] - want[w]) < 1e-9 for w in want)


def test_clashing_names(spark):
    names = ["own", "_own", "_per_id", "_per_h", "_cuts", "h", "spans", "kind", "start", "end", "value", "term"]
    df = spark.createDataFrame([(1, "mail a@b.org now", *range(12))], "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    assert tuple(pii.sanitised(df).first()) == (1, "mail <email> now", *range(12)) and pii.sanitised(df).columns == df.columns
    assert pii.summary(df).first().spans == "email:5:12"


def test_odd_rows(odd, none):
    assert pii.summary(odd).count() == odd.count() and pii.summary(none).count() == 0
    assert pii.sanitised(odd).count() == odd.count()
