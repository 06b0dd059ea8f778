"""Every registered query against its oracle on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from loomwright.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables aren't here")


def rows(df):
    tidy = lambda v: round(float(v), 5) if isinstance(v, float) else v
    return sorted(map(repr, ([tidy(v) for v in r] for r in df)))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = got.select(columns).collect()
    assert found
    if name in catalog.ORACLES:
        con = duckdb.connect()
        for table in os.listdir(SF):
            con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{table}')")
        expected = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
        assert rows(found) == rows(expected)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 607
    assert set(entry.oracle_sql()) <= set(entry.queries())
