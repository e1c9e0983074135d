"""Every registered query of the library against its SQL on the smallest tables."""

import check
import pytest

import __spark_entry__ as entry
from clickloom.plans import oracle, registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.QUERIES
ORACLE = oracle.ORACLE


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= entry.queries().items()
    assert ORACLE.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    ours = QUERIES[name](spark, SF).toPandas()
    assert check.difference(ours, con.sql(ORACLE[name]).df()) is None


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["session_count"] >= 0
    assert len(row) == 17
