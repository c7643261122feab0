"""Every registered query of the domain against its SQL twin on the smallest tables."""

import os

import pytest

from tallywick.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 9) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    rows = catalogue.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    mine = sorted(([plain(r[c]) for c in columns] for r in rows.collect()), key=str)
    if name not in catalogue.oracle_sql():
        assert mine
        return
    twin = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in twin.description]
    assert sorted(names) == columns
    assert mine == sorted(([plain(r[names.index(c)]) for c in columns] for r in twin.fetchall()), key=str)
