import os

import duckdb
import pytest

from gneiss.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    found = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    want = sorted(map(repr, found.fetchall()))
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == want
