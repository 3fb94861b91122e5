"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from gneiss.plans import answers, batches, cases, crawl, flows, graphs, knowledge, markup, relational, retrieval, rules, runs, scans, vectors  # noqa: F401
from gneiss.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def value(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, float):
        return repr(round(x, 5) + 0.0).removesuffix(".0")
    return str(x.tolist() if hasattr(x, "tolist") else x)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(value(float(x) if isinstance(x, int) and not isinstance(x, bool) else x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
