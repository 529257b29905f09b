"""Pieces of SQL that Spark and DuckDB compute to the same bits."""

from __future__ import annotations

import re


def dsum(x: str, scale: int = 4) -> str:
    """A sum of doubles that doesn't depend on the order of the rows."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE)"


def davg(x: str, scale: int = 4) -> str:
    return f"ROUND(CAST(SUM(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE) / COUNT({x}), 6)"


def isum(x: str) -> str:
    return f"CAST(SUM({x}) AS BIGINT)"


def year(x: str) -> str:
    return f"CAST(EXTRACT(YEAR FROM {x}) AS BIGINT)"


_QUOTED = re.compile(r"""'(?:[^']|'')*'|--[^\n]*|`[^`]*`|"((?:[^"]|"")*)\"""")


def spark_sql(text: str) -> str:
    """Identifiers in double quotes, as in SQL, in Spark's own; string literals and comments
    stay as they are."""
    return _QUOTED.sub(lambda m: m[0] if m[1] is None else "`" + m[1].replace('""', '"').replace("`", "``") + "`", text)
