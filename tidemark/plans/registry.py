"""The queries for the engine's own operators and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import basic, htap, ssb, tpch
from tidemark.plans.sqltext import spark_sql
from tidemark.sources.tables import RELATIONAL, views

SQL_QUERIES: dict[str, str] = basic.SUBQUERIES | tpch.QUERIES | ssb.QUERIES


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query over the tables of a folder. Double quotes name identifiers, as in SQL; only the
    tables whose names occur in the text are opened."""
    words = set(re.findall(r"\w+", text.lower()))
    views(spark, sf_dir, tuple(t for t in RELATIONAL if t in words))
    return spark.sql(spark_sql(text))


def queries() -> dict:
    return basic.QUERIES | {name: lambda s, d, text=text: sql(s, d, text) for name, text in SQL_QUERIES.items()} | htap.QUERIES


def oracle_sql() -> dict[str, str]:
    return basic.SQL | SQL_QUERIES | htap.SQL
