"""Every registered query of the engine against its SQL in DuckDB, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from lumaframe.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 5) + 0.0 if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(f"SELECT * FROM ({ORACLE[name]}) LIMIT 10000000").df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    first = QUERIES[name](spark, SF).collect()
    assert first and sorted(map(str, first)) == sorted(map(str, QUERIES[name](spark, SF).collect()))
