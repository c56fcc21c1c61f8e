"""Every registered query with SQL against DuckDB; the others run and give rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = df.collect()
    if (sql := entry.oracle_sql().get(name)) is None:
        assert got or name in ("filename_plan",)
        return
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    want = result.fetchall()
    assert sorted(names) == sorted(df.columns)
    a, b = rows(df.columns, [tuple(r) for r in got]), rows(names, want)
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)


def test_entry(spark):
    assert entry.entry(spark).count() == 15


def test_sizes_of_large_keys(spark, tmp_path):
    """Sizes beyond 1,024 GB stay in GB, as the SQL has them."""
    rows = "SELECT k AS p_partkey, 'Red_ring x' AS p_name, 50 AS p_size FROM (VALUES (0::BIGINT), (1023), (149999), (156385), (1199999)) t(k)"
    duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    df = entry.queries()["slug_name_bytes"](spark, str(tmp_path))
    want = con.execute(entry.oracle_sql()["slug_name_bytes"])
    names = [c[0] for c in want.description]
    assert rows_of(df, names) == sorted(want.fetchall())


def rows_of(df, names):
    return sorted(tuple(r) for r in df.select(*names).collect())
