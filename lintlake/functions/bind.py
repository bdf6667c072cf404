"""Evaluate-once helpers for expressions used inside lambdas.

An expression written inside a lambda is evaluated for every element, and a projected column
that is read once may be inlined into such a lambda. ``let`` binds a value to a lambda variable
and ``pin`` puts a generator of one row between two projections; both compute the value once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with extra columns that later projections read instead of recomputing."""
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_pinned")
    return df.select("*", packed).select(*df.columns, "_pinned.*")
