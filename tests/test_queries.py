"""Every registered query with SQL gives the rows its SQL gives."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle import compare

QUERIES, SQL = entry.queries(), entry.oracle_sql()
MODELS = sorted(n for n in set(QUERIES) - set(SQL) if not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    problems, _ = compare(spark, QUERIES[name], SQL[name], SF)
    assert not problems, problems


@pytest.mark.parametrize("name", MODELS)
def test_model_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 6
