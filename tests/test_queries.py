"""Registered queries against their SQL over the smallest test tables."""

import glob
import math
import os

import duckdb
import pytest

from depsift.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "NULL"
        return repr(round(float(v), 6)) if not isinstance(v, (str, bool)) else str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert canon([tuple(r) for r in found.collect()], found.columns) == canon(want.fetchall(), columns)
