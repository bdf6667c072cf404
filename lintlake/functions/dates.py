"""Bounds of months and cut-off days, as the cost and history reports use them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def iso(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def month_bounds(day: Column) -> tuple[Column, Column]:
    """First and last day of the month of ``day``."""
    return F.trunc(day, "month"), F.last_day(day)


def cutoff(day: Column, days: int) -> Column:
    """The day ``days`` before ``day``."""
    return F.date_sub(day, days)
