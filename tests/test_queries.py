"""Every registered domain query against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from statera.plans import catalog, ops_queries, read_queries, report_queries, scalar_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def normal(rows):
    return sorted(tuple("NULL" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = [tuple(r[c] for c in columns) for r in df.collect()]
    found = duck.execute(catalog.ORACLES[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == columns
    order = [theirs.index(c) for c in columns]
    assert normal(ours) == normal(tuple(r[k] for k in order) for r in found.fetchall())


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
