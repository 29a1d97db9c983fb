"""Every query against its DuckDB oracle on the smallest tables, and goldens worked out by hand."""

import os

import duckdb
import pytest

from veriframe.plans import registry

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(v[k] for k in order)) for v in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.fixture(scope="module")
def inputs(spark):
    """One set of stored chunks and claims for all queries."""
    return registry.Inputs(spark, SF)


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(duck, inputs, name):
    got = registry._plain(registry.QUERIES[name](inputs))
    want = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
