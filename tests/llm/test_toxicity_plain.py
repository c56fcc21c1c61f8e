"""Toxicity against plain loops: counts, learnt exceptions, hits and scores over whole tables."""

import math
import re
from collections import Counter

from corpusloom.llm import toxicity
from corpusloom.llm.common import table


def plain_hits(lexicon, folded):
    """Weight by place: every place against every term."""
    joins = [toxicity._joins(c) for c in folded] + [False]
    found, excused = {}, set()
    for phrase in map(toxicity.fold, lexicon.exceptions):
        for m in re.finditer(f"(?={re.escape(phrase)})", folded):
            a, b = m.start(), m.start() + len(phrase)
            if not (a and joins[a - 1]) and not joins[b]:
                excused |= set(range(a, b))
    for term, weight in lexicon.weights.items():
        key = term.rstrip("*")
        for m in re.finditer(f"(?={re.escape(key)})", folded):
            a, b = m.start(), m.start() + len(key)
            free = toxicity._unspaced(key[0])
            if a not in excused and (free or not (a and joins[a - 1]) and joins[b] == term.endswith("*")):
                found[a] = max(weight, found.get(a, 0.0))
    return found


def plain_score(lexicon, text):
    folded = toxicity.fold(text)
    total = sum(plain_hits(lexicon, folded).values())
    a, b, c = lexicon.curve
    return 1 / (1 + math.exp(-(a + b * math.log1p(total) + c * math.log1p(100 * total / (20 + len(folded) / 6)))))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id", "toxic")
    lexicon = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [(toxicity.fold(texts[r.doc_id]), r.toxic > 0) for r in labels.collect() if r.doc_id in texts and r.toxic is not None]
    n_toxic = sum(t for _, t in rows)
    n_clean = len(rows) - n_toxic
    toxic, clean = Counter(), Counter()
    for folded, bad in rows:
        (toxic if bad else clean).update(toxicity.terms_of(folded))
    odds = {t: (n + 0.5) / (n_toxic + 1) / ((clean[t] + 0.5) / (n_clean + 1)) for t, n in toxic.items() if n >= toxicity.MIN_ROWS}
    learnt = {t: min(6.0, math.log(o)) for t, o in odds.items() if o >= toxicity.MIN_ODDS}
    assert learnt and len(learnt) < toxicity.LEXICON
    seeds = toxicity.Lexicon({s: toxicity.SEED_WEIGHT for s in toxicity.SEEDS}, lexicon.exceptions)
    used = Counter(w for folded, bad in rows if not bad for w in {toxicity._WORD.match(folded, k)[0] for k in plain_hits(seeds, folded)})
    weights = {s: w for s, w in seeds.weights.items() if used[s] <= 2 + 0.002 * n_clean} | learnt
    assert lexicon.weights.keys() == weights.keys() and all(abs(lexicon.weights[t] - w) < 1e-9 for t, w in weights.items())
    for r in toxicity.score(docs, lexicon).collect():
        assert abs(r.score - plain_score(lexicon, r.text)) < 1e-9, r.doc_id


def test_learnt_exceptions(spark):
    """'idiot proof' is harmless in many clean rows; the word alone stays toxic."""
    rows = [(k, f"you are an idiot number {'abcdefgh'[k % 8]}", 1) for k in range(40)] + [(100 + k, f"an idiot proof guide to {'abcdefgh'[k % 8]}", 0) for k in range(60)]
    rows += [(200 + k, "a plain text about weather", 0) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "idiot proof" in lexicon.exceptions and lexicon.weights["idiot"] == 3.0 and not any(e in lexicon.exceptions for e in ("an idiot", "idiot number"))
    lexicon = toxicity.Lexicon({"idiot": 3.0}, lexicon.exceptions)
    assert lexicon.hits("my idiot proof plan") == {} and lexicon.hits("my idiot proofs") == {3: 3.0}


def test_any_script(spark):
    """Terms are learnt in scripts that no seed is of, with and without spaces."""
    bad = {"ru": "ты полный дурак и всё", "el": "είσαι ένας βλάκας εσύ", "hi": "तुम मूर्ख हो भाई", "zh": "你真是个笨蛋吧", "ko": "너는 바보야 정말"}
    good = {"ru": "погода сегодня хорошая и всё", "el": "ο καιρός είναι καλός εσύ", "hi": "आज मौसम अच्छा हो भाई", "zh": "今天天气真是好吧", "ko": "오늘 날씨 정말 좋아요"}
    rows = [(k * 10 + j, t, y) for k in range(30) for j, (t, y) in enumerate([(t, 1) for t in bad.values()] + [(t, 0) for t in good.values()])]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    for lang in bad:
        assert plain_hits(lexicon, toxicity.fold(bad[lang])) == lexicon.hits(toxicity.fold(bad[lang])) != {}, lang
        assert plain_score(lexicon, bad[lang]) > 0.5 > plain_score(lexicon, good[lang]), lang


def test_spans_by_sweep():
    found = {k: 1.0 for k in range(0, 60_000, 3)}
    spans = [(k, k + 4) for k in range(0, 60_000, 9)] + [(5, 3_000)]
    covered = {k for a, b in spans for k in range(a, b + 1)}
    assert toxicity._uncovered(found, spans) == {k: 1.0 for k in found if k not in covered}
