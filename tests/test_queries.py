"""Each query of the reference's operators against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from pulsegrid.plans import chain, queries, shifts, telemetry

QUERIES, SQL = queries.QUERIES | telemetry.QUERIES | chain.QUERIES | shifts.QUERIES, queries.SQL | telemetry.SQL | chain.SQL | shifts.SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables():
    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return db


def same(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = same(found.select(*columns).collect())
    if name in SQL:
        expected = tables.execute(SQL[name])
        names = [x[0] for x in expected.description]
        assert sorted(names) == columns
        assert rows == same([x[names.index(c)] for c in columns] for x in expected.fetchall())
