"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import math
import os

import pytest

from loomgraph.plans import catalogue_extract as catalogue

DATA = os.environ.get("LOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}/*.parquet" if os.path.isdir(f"{DATA}/{name}") else f"{DATA}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(catalogue.SQL[name])
    at = [list(rel.columns).index(c) for c in cols]
    assert len(rel.columns) == len(cols)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
