"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from traceweft.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


def order(row):
    return tuple((v is None, isinstance(v, str), round(v, 4) if isinstance(v, float) else v if isinstance(v, (int, str)) and v is not None else str(v)) for v in row)


def alike(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    rows = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=order)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=order)
    assert len(got) == len(rows)
    for a, b in zip(got, rows):
        assert all(map(alike, a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("keys", [range(60_000), range(0, 17 * 4_000, 17), [*range(1, 17), *range(0, 17 * 4_000, 17)]], ids=["large minority", "minorities alone", "few others"])
def test_minorities_stay_whole_at_any_size(spark, tmp_path, keys):
    """Beyond 2,000 rows, and beyond the whole budget, minorities are kept as the SQL says."""
    name, path = "smp07_minority_preserving", f"{tmp_path}/orders.parquet"
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(path)
    got = catalog.queries()[name](spark, str(tmp_path)).select("id", "label", "copy").collect()
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{path}/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(f"select id, label, copy from ({catalog.oracle_sql()[name]})").fetchall())
