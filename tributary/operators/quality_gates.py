"""Issues of rows, readiness, gate status, exclusion from handoff, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(rules: dict[str, Column]) -> Column:
    """Codes of the rules that hold, in the order of the rules."""
    return F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items())), lambda x: x.isNotNull())


def readiness(codes: Column, severe: list[str], moderate: list[str], minor: list[str]) -> Column:
    """not_ready, low, medium or high, by the worst issue."""
    some = lambda own: F.arrays_overlap(codes, F.array(*map(F.lit, own)))
    return F.when(some(severe), "not_ready").when(some(moderate), "low").when(some(minor), "medium").otherwise("high")


def gate(ready: Column, reference_only: Column) -> Column:
    """Where a row goes: blocked, reference_only, manual, suggest or auto."""
    return F.when(ready == "not_ready", "blocked").when(reference_only, "reference_only").when(ready == "low", "manual").when(ready == "medium", "suggest").otherwise("auto")


def review_priority(status: Column, has_value: Column) -> Column:
    return F.when((status == "blocked") & has_value, "critical").when(status == "blocked", "high").when(status == "manual", "medium").otherwise("low")


def readiness_score(high: Column, medium: Column, low: Column, not_ready: Column) -> Column:
    """100 for all high; not_ready rows count against."""
    n = high + medium + low + not_ready
    return F.when(n > 0, F.round((high + 0.65 * medium + 0.25 * low - 0.15 * not_ready) / n * 100, 4)).otherwise(F.lit(0.0))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of each value of a column per row key, zero-filled."""
    return df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))


def handed_off(df: DataFrame, reasons: Column) -> DataFrame:
    """df with exclusion_reasons and whether none holds."""
    return df.withColumn("exclusion_reasons", reasons).withColumn("handed_off", F.size("exclusion_reasons") == 0)
