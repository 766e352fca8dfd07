"""Every query of the library runs on the smallest tables and agrees with its SQL."""

import os

import pytest

from quarry.plans import catalog

SF = "/root/testdata/sf0.001"
SLOW = {"pagerank_personalized"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toArrow()
    if name not in catalog.ORACLE:
        assert got.num_columns
        return
    expected = duck.sql(catalog.ORACLE[name]).to_arrow_table()
    columns = sorted(expected.column_names)
    assert columns == sorted(got.column_names)
    duck.register("expected", expected.select(columns))
    duck.register("got", got.select(columns))
    for a, b in (("expected", "got"), ("got", "expected")):
        assert duck.sql(f"FROM {a} EXCEPT ALL FROM {b}").limit(3).fetchall() == []
