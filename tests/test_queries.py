"""Every registered query against its SQL, on the smallest sample."""

from __future__ import annotations

import pytest
from compare import compare

import __spark_entry__ as contract
from tenderloom.plans import oracle, queries

QUERIES = queries.queries()
SQL = oracle.oracle_sql()


def test_every_query_has_its_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sample, name):
    good, detail = compare(spark, sample, name, QUERIES[name], SQL[name])
    assert good, detail


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
