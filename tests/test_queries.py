"""Every registered query of the reference's operators against its SQL."""

from __future__ import annotations

import os

import pytest

from foliant.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    assert got == sorted(want.fetchall(), key=key)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE)
