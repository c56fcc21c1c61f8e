"""Exact search by cells against a full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search
from corpusloom.operators.cells import CellTable


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    spots = rng.standard_normal((20, 8)) * 10
    x = spots[rng.integers(0, 20, 4000)] + rng.standard_normal((4000, 8))
    x[:1300] = x[0]  # a third are copies
    rows = [(k, v.tolist(), "a" if k % 50 == 0 else "b") for k, v in enumerate(x.astype(np.float32))] + [(9999, None, "a")]
    df = spark.createDataFrame(rows, "sub_id long, embedding array<float>, kind string").repartition(4)
    return df.persist(), CellTable.write(df, f"{tmp_path_factory.mktemp('cells')}/t", cells=40)


@pytest.mark.parametrize("at", [0, 1300, 2500, 3999])
def test_same_rows_as_a_scan(spark, clustered, at):
    df, held = clustered
    q = [float(v) for v in df.where(F.col("sub_id") == at).first().embedding]
    for k in (1, 10, 200):
        want = [(r.sub_id, r.distance) for r in search.nearest(df.where("embedding is not null"), q, k).select("sub_id", "distance").collect()]
        assert [(r.sub_id, r.distance) for r in held.nearest(q, k).select("sub_id", "distance").collect()] == want
        assert held.last["read"] < held.last["cells"] / 2 and held.last["of"] == 4000
    few = df.where("kind = 'a' and embedding is not null")
    for k in (5, 70, 500):  # more than there are, at last
        want = [r.sub_id for r in search.nearest(few, q, k).collect()]
        assert [r.sub_id for r in held.nearest(q, k, F.col("kind") == "a").collect()] == want
    assert len(want) == 80 and held.last["read"] == held.last["cells"]


def test_opened_again_and_empty(spark, clustered, tmp_path):
    _, held = clustered
    again = CellTable(spark, held.path)
    assert again.nearest([0.0] * 8, 3).collect() == held.nearest([0.0] * 8, 3).collect()
    none = CellTable.write(spark.createDataFrame([(1, None)], "sub_id long, embedding array<float>"), f"{tmp_path}/none")
    assert none.nearest([0.0] * 8, 3).count() == 0
