from pathlib import Path

import pytest

import __spark_entry__
from evidex.plans import core_queries, extraction_queries, field_queries

DATA = Path("/root/testdata/sf0.001")
REGISTRIES = (core_queries.registry, extraction_queries.registry, field_queries.registry)
QUERIES = {name: fn for r in REGISTRIES for name, fn in r.queries.items()}
SQL = {name: text for r in REGISTRIES for name, text in r.sql.items()}


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, against_sql):
    against_sql(QUERIES[name], SQL[name], DATA)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    """Queries that SQL doesn't express give rows here; their operators have tests of their own."""
    assert QUERIES[name](spark, str(DATA)).count() > 0
