"""Every query of the engine against its SQL in DuckDB."""

import pytest

from tidemark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, sf_dir, duck, same):
    same(QUERIES[name](spark, sf_dir), duck.sql(SQL[name]))


def test_whole_joins_reach_every_row(spark, sf_dir):
    orders = [(r.o_orderkey, None if r.o_custkey == 7 else r.o_custkey) for r in spark.read.parquet(f"{sf_dir}/orders.parquet").collect()]
    customers = {r.c_custkey for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect()} - {11}
    at = {how: [r.o_orderkey for r in QUERIES[f"join_{how}"](spark, sf_dir).select("o_orderkey").collect()] for how in ("inner", "left", "semi", "anti")}
    met = sorted(o for o, c in orders if c in customers)
    assert sorted(at["left"]) == sorted(o for o, _ in orders) and sorted(at["inner"]) == sorted(at["semi"]) == met and sorted(at["anti"] + met) == sorted(at["left"])
    assert 0 < len(met) < len(orders)
    suppliers = {r.s_suppkey for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").collect()}
    assert {r.s_suppkey for r in QUERIES["join_theta_left"](spark, sf_dir).collect()} == suppliers


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
