"""Frames and order statistics: Spark's window functions and quantiles under one name each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, keys: list[str], order: list[str], tiles: int = 4) -> DataFrame:
    """df with tile, percent_rank, cume_dist and the second value of the first order column in its partition."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({"tile": F.ntile(tiles).over(w), "percent_rank": F.percent_rank().over(w), "cume_dist": F.cume_dist().over(w), "second": F.nth_value(order[0], 2).over(whole)})


def within(df: DataFrame, keys: list[str], at: str, width: int, value: Column) -> Column:
    """The sum of value over the rows of a partition at most `width` before the row's number `at` (a RANGE frame)."""
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(at).rangeBetween(-width, Window.currentRow))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """Per key: quantiles of bounded size, and an approximate distinct count."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile_approx(value, shares, accuracy).alias("quantiles"), F.approx_count_distinct(value, 0.01).alias("n_distinct"))
