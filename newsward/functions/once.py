"""Costly columns that later steps use more than once, and parts of long arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated once per row.

    A filter on a plain column is pushed below it with the column's whole
    expression put in at every mention; it cannot pass a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def part(array: Column, first: Column, last: Column) -> Column:
    """Elements ``first`` to ``last`` (left out), from 0. ``slice`` copies the whole array each
    time, which makes many parts of a long one quadratic; this takes what is asked for."""
    return F.when(last > first, F.transform(F.sequence(first, last - 1), lambda k: F.get(array, k)))
