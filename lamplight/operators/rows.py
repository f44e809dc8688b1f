"""Array columns to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def exploded(rows: DataFrame, array: Column, at: str, item: str) -> DataFrame:
    """One row per element with its index.

    The outer form with a filter behind it yields the same rows as the inner one, which
    would have the optimizer add a test on the array's size below and so compute a
    costly array twice.
    """
    return rows.select("*", F.posexplode_outer(array).alias(at, item)).where(F.col(at).isNotNull())
