"""Language identification against plain loops over a whole table: n-grams, document frequencies, cosines, rejection."""

import math
import zlib
from collections import Counter

from corpusloom.llm import langid, queries
from corpusloom.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_counts(text):
    if text is None or not any(map(str.isalpha, text)):
        return None
    letters = (b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode("utf-8"))
    raw = b" " + b" ".join(bytes(letters).split()) + b" "
    found = Counter()
    for n in range(1, 5):
        for k in range(len(raw) - n + 1):
            found[((int.from_bytes(raw[k : k + n], "big") * 2654435761 + n * 40503) % 2**32) >> 20] += 1
    return found


def plain_vector(counts, idf):
    v = {k: math.log1p(n) * idf[k] for k, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items()}


def test_whole_table(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text", "lang").collect()
    train = [r for r in rows if r.lang is not None and (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 != 1)]
    counts = {r.doc_id: plain_counts(r.text) for r in rows}
    seen = [c for r in train if (c := counts[r.doc_id]) is not None]
    df = Counter(k for c in seen for k in c)
    idf = [math.log((len(seen) + 1) / (df[k] + 1)) + 0.05 for k in range(langid.BUCKETS)]
    model = langid.fit(spark.createDataFrame(train))
    assert max(abs(a - b) for a, b in zip(idf, model.idf)) < 1e-12
    assert model.langs == sorted({r.lang for r in train if counts[r.doc_id] is not None}) and len(model.owner) > len(model.langs)
    centres = [c.tolist() for c in model.centres]
    assert all(abs(sum(x * x for x in c) - 1) < 1e-9 for c in centres)
    got = {r.doc_id: r for r in queries.op3_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own = got[r.doc_id]
        assert own.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if counts[r.doc_id] is None:
            assert (own.lang_pred, own.score) == ("und", 0.0)
            continue
        v = plain_vector(counts[r.doc_id], idf)
        sims = [sum(x * c[k] for k, x in v.items()) for c in centres]
        best = max(sims)
        assert abs(own.score - min(1.0, max(0.0, best))) < 1e-9
        assert own.lang_pred in {model.langs[o] for s, o in zip(sims, model.owner) if s > best - 1e-9}
        reach = model.reach[model.langs.index(own.lang_pred)]
        assert own.rejected == (best < reach) or abs(best - reach) < 1e-9
