"""Registered queries on literals give the rows that were written down for them."""

import duckdb
import pytest

from kinsieve import queries, source_queries

NAMES = sorted(n for n, f in queries.queries().items() if f.__module__ == source_queries.__name__ and not n.endswith("_docs"))


@pytest.mark.parametrize("name", NAMES)
def test_rows(spark, name):
    got = queries.queries()[name](spark, "")
    columns = sorted(got.columns)
    found = duckdb.connect().execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(found, key=key)
