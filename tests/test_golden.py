"""Queries over cases with known results give what their SQL holds."""

import duckdb
import golden_cases
import known_tables
import pytest


@pytest.mark.parametrize("name", sorted(golden_cases.QUERIES | known_tables.QUERIES))
def test_known_results(spark, name):
    found = (golden_cases.QUERIES | known_tables.QUERIES)[name](spark, "")
    known = duckdb.connect().execute((golden_cases.oracle_sql() | known_tables.oracle_sql())[name])
    columns = [c[0] for c in known.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(str([r[c] for c in columns]) for r in found.collect()) == sorted(str(list(r)) for r in known.fetchall())
