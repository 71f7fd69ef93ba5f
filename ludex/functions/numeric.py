"""Numeric helpers shared by queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c: Column, digits: int) -> Column:
    """ROUND half away from zero on the decimal value, returned as DOUBLE.

    Going through DECIMAL(38,10) removes last-bit noise of double sums, so the
    value equals the SQL engine's for the same input."""
    return F.round(c.cast("decimal(38,10)"), digits).cast("double")


def safe_div(a: Column, b: Column) -> Column:
    """a / NULLIF(b, 0)."""
    return a / F.nullif(b, F.lit(0))


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """ROUND(100.0 * part / NULLIF(whole, 0), digits)."""
    return rnd(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits)
