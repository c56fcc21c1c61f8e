import zlib
from collections import Counter

import numpy as np

from tests.llm.test_mixing import water_fill, words
from tests.llm.test_neardup import brute as groups


def test_stages_against_brute_force(spark, sf, tmp_path):
    import corpus_pipeline as cp
    from corpusloom.llm import quality, queries
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in cp.STAGES:
        out = stage(spark, seen[-1], sf)
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
        if name != "token_files":
            assert seen[-1].columns == docs.columns
    rows = [{r.doc_id: r for r in df.collect()} if "text" in df.columns else None for df in seen]

    judged = {r.doc_id: r.kept for r in quality.judge(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert set(rows[1]) == {d for d, kept in judged.items() if kept}
    comp = groups([(d, r.text) for d, r in rows[1].items()], 5, 80)
    assert set(rows[2]) == {d for d, (_, c) in comp.items() if c == d}
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {d for d, r in rows[2].items() if any(b in r.text for b in bench)}
    assert leaks and leaks == set(rows[2]) - set(rows[3])

    sizes, taken = Counter(), Counter()
    for r in sorted(rows[3].values(), key=lambda r: r.source):
        sizes[r.source] += words(r.text)
    times = Counter(r.doc_id for r in seen[4].collect())
    for d, n in times.items():
        taken[rows[3][d].source] += n * words(rows[3][d].text)
    for s, t in water_fill(dict(sizes)).items():
        assert abs(taken[s] - t) <= 0.05 * t
    assert max(times.values()) <= 3

    tok, at = Tokenizer.from_file(queries.tokenizer_path()), 0
    got = sorted(seen[5].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d in sorted(times) for _ in range(times[d])]
    for r in got:
        ids = np.array([*tok.encode(rows[3][r.doc_id].text, add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)


def test_odd_rows_and_clashing_names(spark, odd, none, sf):
    """Every filtering stage on odd rows: the input's columns and values, whatever they are called."""
    import corpus_pipeline as cp
    from pyspark.sql import functions as F

    names = ["kept", "n_words", "anomaly", "rules", "component_id", "_gone", "hit", "item", "size", "target", "reps", "row", "_h"]
    good = odd.limit(1).withColumns({"doc_id": F.lit(77).cast("long"), "text": F.lit(" ".join(f"word{k}" for k in range(99)))})
    df = odd.unionByName(good).withColumns({c: F.lit(f"own {c}") for c in names})
    for name, stage in cp.STAGES[:4]:
        got = stage(spark, df, sf)
        rows = got.collect()
        assert got.columns == df.columns, name
        assert any(r.doc_id == 77 for r in rows) and all(r[c] == f"own {c}" for r in rows for c in names), name
        assert stage(spark, none, sf).count() == 0, name
    assert cp.STAGES[4][1](spark, df, sf).count() == df.count()
