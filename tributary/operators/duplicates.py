"""Duplicate groups, conflicts, survivors and back-filled values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(df: DataFrame, kinds: dict[str, Sequence[str]], row_id: str) -> DataFrame:
    """Per kind of key the groups of more than one row: kind, size, first id."""
    out = None
    for kind, keys in kinds.items():
        own = df.groupBy(*keys).agg(F.count("*").alias("size"), F.min(row_id).alias("first_id")).where("size > 1").select(F.lit(kind).alias("kind"), "size", "first_id")
        out = own if out is None else out.union(own)
    return out


def conflicts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with several values: how many rows and how many values."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(value).alias("n_values")).where("n_values > 1")


def with_duplicate_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Place within the group of equal rows, and the group's size."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"duplicate_rank": F.row_number().over(w.orderBy(*order)).cast("long"), "group_size": F.count("*").over(w)})


def excess(df: DataFrame, group: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per group the rows beyond the first of each key, and the rate of them."""
    inner = df.groupBy(*group, *keys).agg(F.count("*").alias("n"))
    return inner.groupBy(*group).agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("excess")).withColumn("rate", F.round(F.col("excess") / F.col("n_rows"), 6))


def survivors(df: DataFrame, keys: Sequence[str], role: str, roles: Sequence[str], row_id: str, value: str) -> DataFrame:
    """Of each group the row with the best role (then the smallest id), and what may be done: keep,
    dedupe (all values equal) or manual (values conflict)."""
    place = F.array_position(F.array(*map(F.lit, roles)), F.col(role))
    order = F.when(place == 0, F.lit(len(roles) + 1)).otherwise(place)
    out = df.groupBy(*keys).agg(F.min(F.struct(order.alias("o"), F.col(row_id).alias("i"))).alias("b"), F.count("*").alias("size"), F.count_distinct(value).alias("values"))
    action = F.when(F.col("size") == 1, "keep").when(F.col("values") == 1, "dedupe").otherwise("manual")
    return out.select(*keys, F.col("b.i").alias("survivor"), "size", action.alias("action"))


def unique_backfill(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """A blank column takes the value of its key where that has exactly one distinct non-blank value."""
    filled = F.trim(F.coalesce(F.col(column), F.lit(""))) != ""
    one = df.where(filled).groupBy(*keys).agg(F.min(column).alias("_least"), F.max(column).alias("_most"))
    own = one.where(F.col("_least") == F.col("_most")).select(*keys, "_least")
    return df.join(own, list(keys), "left").withColumn(out, F.when(filled, F.col(column)).otherwise(F.col("_least"))).drop("_least")
