"""Every registered query of the graph engine against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from weftgraph.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(row):
    return tuple(None if x is None or isinstance(x, float) and math.isnan(x) else x for x in row)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_says_what_its_sql_says(spark, db, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((plain(r) for r in df.select(columns).collect()), key=str)
    found = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((plain(dict(zip(names, r))[c] for c in columns) for r in found.fetchall()), key=str)
    assert len(got) == len(want)
    assert got == want
