"""Scalar expressions by the names the engine's plans use; each is a built-in Catalyst expression."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    return F.col(name)


def num_lit(value: int | float | bool | None, kind: str | None = None) -> Column:
    """Integers are 64 bits wide unless kind says otherwise; None gives a typed null."""
    if kind is None:
        kind = "boolean" if isinstance(value, bool) else "double" if isinstance(value, float) else "long"
    return F.lit(value).cast(kind)


def str_lit(value: str | None) -> Column:
    return F.lit(value).cast("string")


def date_lit(text: str | None) -> Column:
    return F.lit(text).cast("date")


def divide(a: Column, b: Column, whole: bool = False) -> Column:
    """whole: the quotient of integers stays an integer, truncated towards zero."""
    return F.call_function("div", a, b) if whole else a / b


def date_plus(date: Column, n: int, unit: str) -> Column:
    """unit: DAY, MONTH or YEAR; n may be negative. A date beyond the month's end becomes its last day."""
    if unit == "DAY":
        return F.date_add(date, n)
    return F.add_months(date, n * {"MONTH": 1, "YEAR": 12}[unit])


def date_extract(unit: str, date: Column) -> Column:
    """DAY, MONTH or YEAR as a 64-bit integer."""
    return {"DAY": F.dayofmonth, "MONTH": F.month, "YEAR": F.year}[unit](date).cast("long")


def substr(text: Column, start: int, length: int) -> Column:
    """1-based."""
    return F.substring(text, start, length)


def like(text: Column, pattern: str) -> Column:
    return text.like(pattern)


def in_(value: Column, options: Iterable[Any]) -> Column:
    return value.isin(*options)


def if_(condition: Column, then: Column, otherwise: Column) -> Column:
    return F.when(condition, then).otherwise(otherwise)


def case(branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """CASE WHEN ... as nested ifs."""
    out = F.lit(None) if otherwise is None else otherwise
    for condition, then in reversed(branches):
        out = F.when(condition, then).otherwise(out)
    return out


def is_true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_not_true(condition: Column) -> Column:
    return ~is_true(condition)


def and_(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def or_(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def cast(value: Column, kind: str) -> Column:
    """Strings to int, long, double or decimal; text that is no number gives null."""
    return value.try_cast(kind)
