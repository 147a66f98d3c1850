"""Local names for column expressions inside higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    An expression used within a lambda is computed for each element again;
    bound as the element of a one-element array it is not.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column computed once, in a step of its own.

    It is neither merged into later expressions (a Python function takes no
    argument with a lambda in it) nor computed again by filters on it.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
