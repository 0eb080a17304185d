"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from gridloom import catalog, catalog_files

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for f in os.listdir(FOLDER):
        made.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return made


SQL = {**catalog.ORACLE_SQL, **catalog_files.ORACLE_SQL}
QUERIES = {**catalog.QUERIES, **catalog_files.QUERIES}


def plain(d):
    return sorted(map(repr, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, con, name):
    expected = con.execute(SQL[name]).df()
    found = QUERIES[name](spark, FOLDER).toPandas()
    assert sorted(found.columns) == sorted(expected.columns)
    assert plain(found[list(expected.columns)]) == plain(expected)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys()))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["mi"] and entry.oracle_sql().keys() <= entry.queries().keys()


def test_rasters_read_lineitem_once(spark):
    """What queries do with a raster, round by round, does not read the table again."""
    from gridloom import catalog

    image = catalog.scaled(spark, "/root/testdata/sf0.001")
    assert "FileScan" not in image._jdf.queryExecution().toString() and image.count() == catalog.R2.size
