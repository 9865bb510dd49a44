"""As-of joins, neighbours, nearest rows and range ends: all as windows over one order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(df: DataFrame, group: Sequence[str], order: Sequence[str], is_anchor: Column, value: Column, out: str, strict: bool = False) -> DataFrame:
    """The value of the latest anchor at or before each row (before it, if strict)."""
    end = -1 if strict else Window.currentRow
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    return df.withColumn(out, F.last(F.when(is_anchor, value), ignorenulls=True).over(w))


def nearest(df: DataFrame, group: Sequence[str], order: Sequence[str], position: Column, is_anchor: Column, value: Column, out: str) -> DataFrame:
    """The value of the nearest anchor on either side; of equally near ones the following one."""
    w = Window.partitionBy(*group).orderBy(*order)
    anchor = F.when(is_anchor, F.struct(position.alias("p"), value.alias("v")))
    before = F.last(anchor, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(anchor, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    df = df.withColumns({"_before": before, "_after": after, "_at": position})
    follow = F.col("_before").isNull() | (F.col("_after.p") - F.col("_at") <= F.col("_at") - F.col("_before.p"))
    return df.withColumn(out, F.when(F.col("_after").isNotNull() & follow, F.col("_after.v")).otherwise(F.col("_before.v"))).drop("_before", "_after", "_at")


def neighbours(df: DataFrame, group: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """previous_ and next_ of a column."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumns({f"previous_{column}": F.lag(column).over(w), f"next_{column}": F.lead(column).over(w)})


def nearby(df: DataFrame, group: Sequence[str], order: Sequence[str], column: str, reach: int, out: str = "nearby") -> DataFrame:
    """Values of the rows up to `reach` before and after, in order, without the row's own."""
    w = Window.partitionBy(*group).orderBy(*order)
    around = [F.lag(column, -d).over(w) for d in range(-reach, reach + 1) if d]
    return df.withColumn(out, F.filter(F.array(*around), lambda x: x.isNotNull()))


def range_ends(df: DataFrame, group: Sequence[str], start: str, last: Column, out: str = "end") -> DataFrame:
    """Inclusive ends: one before the next greater start, else `last`; rows may share a start."""
    starts = df.select(*group, start).distinct()
    w = Window.partitionBy(*group).orderBy(start)
    starts = starts.withColumn("_next", F.lead(start).over(w))
    shared = F.count("*").over(Window.partitionBy(*group, start)) > 1
    return df.withColumn("shared_start", shared).join(starts, [*group, start]).withColumn(out, F.coalesce(F.col("_next") - 1, last)).drop("_next")


def range_topology(df: DataFrame, group: Sequence[str], start: str, end: str) -> DataFrame:
    """Gap to and overlap with the next range, in order of start."""
    w = Window.partitionBy(*group).orderBy(start, end)
    step = F.lead(start).over(w) - F.col(end) - 1
    return df.withColumns({"gap": F.greatest(step, F.lit(0)), "overlap": F.greatest(-step, F.lit(0))})


def weighted_consensus(df: DataFrame, group: Sequence[str], value: str, weight: str, share: float = 0.72, least: int = 2) -> DataFrame:
    """The value with most weight per group, and whether it dominates (its share, and enough votes)."""
    votes = df.groupBy(*group, value).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    best = F.max_by(F.struct(value, "w", "n"), F.struct("w", -F.col(value)))
    out = votes.groupBy(*group).agg(best.alias("b"), F.sum("w").alias("total"))
    rate = F.col("b.w") / F.col("total")
    return out.select(*group, F.col(f"b.{value}").alias(value), F.round(rate, 6).alias("share"), F.col("b.n").alias("votes"), ((rate >= share) & (F.col("b.n") >= least)).alias("dominant"))
