"""Queries with SQL against DuckDB; all of them run."""

import pytest

from tidemark.llm import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, sf_dir, duck, same):
    same(QUERIES[name](spark, sf_dir), duck.sql(SQL[name]))


def test_all_ten_are_there():
    import __spark_entry__ as e

    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(e.queries())
