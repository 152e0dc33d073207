"""Columns that are computed once however often they are used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the columns made by a generator of one row.

    The optimizer merges projections and would put a costly expression into every place that uses it; it
    does not merge through a generator, which costs no shuffle.
    """
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
