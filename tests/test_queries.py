"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from canopy.plans import more  # noqa: F401
from canopy.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(t, cols):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in zip(*[t.column(c).to_pylist() for c in cols]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name in ORACLES:
        want = con.sql(ORACLES[name]).arrow()
        want = want.read_all() if hasattr(want, "read_all") else want
        cols = sorted(want.column_names)
        assert sorted(got.column_names) == cols
        assert rows(got, cols) == rows(want, cols)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0
