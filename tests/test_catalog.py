"""Every query of the catalog runs on the smallest driver tables and agrees with its SQL."""

import os
from collections import Counter

import duckdb
import pytest
from estatelens import catalog

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF_DIR}/{name}'")
    return con


def plain(row):
    return tuple(v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v for v in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    found = catalog.QUERIES[name](spark, SF_DIR).toArrow()
    if name not in catalog.ORACLES:
        assert found.num_columns
        return
    cursor = tables.cursor()
    cursor.execute(catalog.ORACLES[name])
    columns = [x[0] for x in cursor.description]
    rows = Counter(map(plain, cursor.fetchall()))
    assert sorted(columns) == sorted(found.column_names)
    assert Counter(map(plain, zip(*(found[c].to_pylist() for c in columns), strict=True))) == rows
