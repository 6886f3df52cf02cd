"""Every registered query of the graph operators against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from factgraph.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if v.__class__.__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name not in ORACLES:
        return
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    place = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in place) for r in found.fetchall()), key=repr)
    assert sorted(names) == columns
    assert sorted((tuple(plain(v) for v in r) for r in rows), key=repr) == want
