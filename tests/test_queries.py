"""The registered queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    text = df.map(lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v))
    return sorted(map(tuple, text.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    found, told = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(told.columns)
    fix = lambda d: d.astype({c: "float64" for c in d.columns if d[c].dtype.kind in "iuf"})
    assert plain(fix(found)) == plain(fix(told))


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
