"""Every registered query of the engine against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tesserae import queries as catalog

DATA = "/root/testdata/sf0.001"


def rows(frame):
    def value(v):
        if isinstance(v, bool | str) or v is None:
            return "null" if v is None else str(v)
        try:
            return "null" if math.isnan(v) else f"{v:.6f}"
        except TypeError:
            return str(v)

    names = sorted(frame.columns)
    return names, sorted(tuple(value(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, oracle, name):
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(oracle.execute(catalog.SQL[name]).df())
