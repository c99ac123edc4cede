from pathlib import Path

import pytest

import __spark_entry__
from evidex.llm.queries import registry

DATA = Path("/root/testdata/sf0.001")
#: Rows of the tables that a query must give one row each for.
WHOLE = {"p8_ids": "documents", "p8_token_counts": "documents", "p10_statistics": "documents"}


def test_all_there():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"p{k}_") for n in names) for k in range(1, 11))
    assert set(registry.queries) <= set(names)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.sql))
def test_against_sql(name, against_sql):
    against_sql(registry.queries[name], registry.sql[name], DATA)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(registry.queries) - set(registry.sql)))
def test_without_sql(spark, name):
    """As many rows as the table has where each row counts, else some."""
    n = registry.queries[name](spark, str(DATA)).count()
    assert n == spark.read.parquet(str(DATA / f"{WHOLE[name]}.parquet")).count() if name in WHOLE else n > 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_unmatched_are_those_found_unmatched(spark):
    """p5_unmatched counts the records that p5_found gives -1, and p5_values gives each distinct title once."""
    found = registry.queries["p5_found"](spark, str(DATA)).where("ref_id = -1").groupBy("field").count()
    missed = registry.queries["p5_unmatched"](spark, str(DATA)).groupBy("field").sum("records")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, missed.collect()))
    values = registry.queries["p5_values"](spark, str(DATA)).collect()
    assert len({r.value for r in values}) == len(values) and all((r.ref_id == -1) == (r.way is None) for r in values)
