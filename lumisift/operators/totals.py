"""Aggregates of a key's rows given back to those rows, where one key may hold a large share of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals_of(df: DataFrame, key: str, *totals: Column) -> DataFrame:
    """The totals of each key, which is named key__.

    The least key of a group is its key, under a name by which the planner does not know the groups to be dealt
    already. A join on key__ therefore shuffles them once more, and both its sides are plain shuffles, the kind of
    which adaptive execution splits skewed partitions.
    """
    return df.groupBy(key).agg(F.min(key).alias("key__"), *totals).drop(key)


def with_totals(df: DataFrame, key: str, *totals: Column) -> DataFrame:
    """df with the totals of each row's key; rows with a null key go."""
    return df.join(totals_of(df, key, *totals), F.col(key) == F.col("key__")).drop("key__")
