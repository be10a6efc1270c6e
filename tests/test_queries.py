"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 4) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert rows
        return
    want = duck.sql(catalogue.ORACLES[name])
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)
