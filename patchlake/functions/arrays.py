"""Array helpers that keep costly expressions from being computed twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_rows(df: DataFrame, array: Column, name: str, *keep) -> DataFrame:
    """(keep..., name): one row per non-NULL element.

    The outer form, filtered afterwards: for the inner one Catalyst puts a
    copy of the array expression, to test for emptiness, below the generator.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, array: Column, name: str, *keep, pos: str = "pos") -> DataFrame:
    """(keep..., pos, name): the same with positions from 0."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())
