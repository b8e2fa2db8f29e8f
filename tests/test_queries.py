"""Every registered query against its SQL text in DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest
from check_queries import compare, connect

from reliefgrid.plans import oracles, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    good, _, note = compare(spark, con, name, queries()[name], oracles().get(name), SF_DIR)
    assert good, note
    assert "TYPES" not in note, note


def test_entry_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 90
