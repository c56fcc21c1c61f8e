import numpy as np
import pytest

from corpusloom.llm import queries, whitening


def plain(vectors, k=4):
    """n, S, components, eigenvalues and trace by numpy alone."""
    x = np.floor(np.array(vectors, np.float32).astype(float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    centred = fit - fit.sum(0) / len(fit)
    v = centred.T @ centred / len(fit)
    e, u = np.linalg.eigh(v)
    return x, len(fit), fit.sum(0), u[:, ::-1][:, :k], e[::-1][:k], np.trace(v)


def check(rows, vectors, ids):
    x, n, sums, u, e, trace = plain(vectors)
    want = dict(zip(ids, (x - sums / n) @ u / np.sqrt(e)))
    exact = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for i, row in zip(ids, x)}
    assert len(rows) == len(ids) * len(e)
    sign = {}
    for r in rows:
        w = want[r.vec_id][r.component - 1]
        if abs(w) > 0.1:
            sign.setdefault(r.component, np.sign(w * r.whitened))
        assert (r.n, r.deviation) == (n, exact[r.vec_id])
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9)
        assert r.identity_error < 1e-9
    for r in rows:
        assert r.whitened * sign[r.component] == pytest.approx(want[r.vec_id][r.component - 1], abs=1e-6)


def test_query(spark, sf):
    data = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    check(queries.op12_embedding_whitening(spark, sf).collect(), [r.embedding for r in data], [r.vec_id for r in data])


def test_converges_without_full_dimension(spark):
    """A spectrum that falls fast needs the narrow basis only."""
    rng = np.random.default_rng(3)
    data = rng.standard_normal((400, 40)) * 100 * 0.3 ** np.arange(40)
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(data)], "vec_id long, embedding array<double>").repartition(5)
    model = whitening.fit(df)
    assert model.basis == 12 and model.residuals[-1] <= whitening.TOLERANCE
    x = np.unique(np.floor(data * 256).astype(np.int64), axis=0)
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:4]
    assert model.eigenvalues == pytest.approx(e, rel=1e-10) and model.identity_error < 1e-9


def test_odd_rows(spark):
    good = [[0.1, 0.2, -0.3], [0.5, -0.25, 0.75], [0.1, 0.2, -0.3], [1.0, 0.0, -0.0], [0.3, 0.9, 0.4], [-0.6, 0.1, 0.2]]
    odd = [None, [], [None, 1.0, 2.0], [float("nan"), 1.0, 2.0], [1.0, float("inf"), 0.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    rows = [(k if k else None, v, "x", k) for k, v in enumerate(good + odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string, _x long")
    model = whitening.fit(df)
    assert model.n == 5 and len(model.eigenvalues) == 3
    got = whitening.whiten(df, model)
    assert got.columns == ["vec_id", "embedding", "_x", "whitened", "deviation"]
    got = sorted(got.collect(), key=lambda r: r._x)
    assert [r._x for r in got] == list(range(6)) and got[0].vec_id is None
    x, n, sums, *_ = plain(good)
    assert [r.deviation for r in got] == [int(((n * v - sums) ** 2).sum()) for v in x]
    assert got[0].whitened == got[2].whitened


def test_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = spark.createDataFrame(rows, schema)
        model = whitening.fit(df)
        assert len(model.eigenvalues) == 0
        assert all(r.whitened == [] for r in whitening.whiten(df, model).collect())


def test_large_entries():
    x = np.array([[2**62, -(2**62)], [3, 4]], np.int64)
    assert whitening.deviations(x, 7, [1, 2]) == [None, (21 - 1) ** 2 + (28 - 2) ** 2]
    assert whitening.deviations(np.array([[5, 6]]), 2, [1, 2]) == [81 + 100]
