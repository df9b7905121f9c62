"""Rounding, ratios, money and date helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(col: Column) -> Column:
    return col.cast("decimal(18,2)")


def total(col: Column) -> Column:
    """A sum of money over any number of rows."""
    return col.cast("decimal(38,2)")


def product(a: Column, b: Column) -> Column:
    """Of two whole numbers, beyond the range of a long."""
    return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")


def num(col: Column) -> Column:
    return col.cast("double")


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part / whole as double, null when the whole is zero; half-even when rounded."""
    value = F.try_divide(num(part), num(whole))
    return value if digits is None else F.bround(value, digits)


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage, 0 when there is nothing to count."""
    return F.coalesce(F.bround(F.try_divide(100 * num(part), num(whole)), digits), F.lit(0.0))


def flag(cond: Column) -> Column:
    """1 for true, 0 for false or null."""
    return F.when(cond, 1).otherwise(0).cast("bigint")


def day(value) -> Column:
    """A date parameter: ISO text or a column."""
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def days_between(later, earlier) -> Column:
    return F.datediff(day(later), day(earlier)).cast("bigint")


def band(score: Column, bands: Sequence[tuple[float, str]]) -> Column:
    """Half-open bands given as (lower bound, label); below the lowest bound is null.

    Bands are a short list, so they become one CASE expression and need no join.
    """
    expr = None
    for low, name in sorted(bands, reverse=True):
        expr = F.when(score >= low, name) if expr is None else expr.when(score >= low, name)
    return expr


def minutes_between(later: Column, earlier: Column) -> Column:
    """Whole minutes from ``earlier`` to ``later`` (timestamps)."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(60000000)).cast("bigint")
