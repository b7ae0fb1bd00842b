"""Null-aware rolling windows over a series ordered by time."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

SERIES, TIME = "series_id", "timestamp_utc_ms"


def whole():
    return Window.partitionBy(SERIES).orderBy(TIME)


def back(n: int):
    """The last n rows, the current one included."""
    return whole().rowsBetween(1 - n, 0)


def ahead(a: int, b: int):
    return whole().rowsBetween(a, b)


def roll(agg, x: Column, n: int, least: int | None = None) -> Column:
    """agg(x) over n rows; null with fewer than ``least`` (n) values."""
    w = back(n)
    return F.when(F.count(x).over(w) >= (least or n), agg(x).over(w))


def lag(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(whole())


def lead(x: Column, n: int = 1) -> Column:
    return F.lead(x, n).over(whole())


def flag(cond: Column) -> Column:
    """1.0 if true, else 0.0: null comparisons are 0.0."""
    return F.when(cond, 1.0).otherwise(0.0)


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def div(a, b) -> Column:
    return F.try_divide(a, b)
