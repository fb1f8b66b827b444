"""Small building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    An expression named inside the lambda of a higher-order function is computed again for every
    element; bound this way it is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rows_of(df: DataFrame, keep: list, array: Column, value: str, pos: str | None = None) -> DataFrame:
    """One row per element of a computed array; an empty array gives no row.

    A plain explode makes the planner add a filter on the array below it, and so compute the array
    more than once. The outer form with a filter above does not.
    """
    if pos is None:
        return df.select(*keep, F.explode_outer(array).alias(value)).where(F.col(value).isNotNull())
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())
