"""Two mappers, two pipelines, or predictions and the truth, held against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.labels import safe_rate


def outcome(left: Column, right: Column) -> Column:
    """What two mappers say of a row."""
    return (
        F.when(left.isNull() & right.isNull(), "neither")
        .when(right.isNull(), "left_only")
        .when(left.isNull(), "right_only")
        .when(left == right, "agree")
        .otherwise("conflict")
    )


def compared(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Every key of either side with both values and the outcome; one row per key on each side."""
    a, b = (x.select(key, F.col(value).alias(n)) for x, n in ((left, "left_value"), (right, "right_value")))
    return a.join(b, key, "full").withColumn("outcome", outcome(F.col("left_value"), F.col("right_value")))


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rows, comparable ones (both say something), agreements, and their share of the comparable."""
    both, agree = F.count_if(F.col("outcome").isin("agree", "conflict")), F.count_if(F.col("outcome") == "agree")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), both.alias("comparable"), agree.alias("agreed"), F.round(safe_rate(agree, both), 6).alias("agreement"))


def losing_all(baseline: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Rows that have candidates in the baseline, and none once a filter has run."""
    return baseline.select(key).distinct().join(kept.select(key).distinct(), key, "left_anti")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: sizes of two sets of keys, of what they share, and the Jaccard index."""
    a, b = (x.select(key).distinct().withColumn(n, F.lit(1)) for x, n in ((left, "a"), (right, "b")))
    met = a.join(b, key, "full").agg(F.count("a").alias("n_left"), F.count("b").alias("n_right"), F.count(F.col("a") + F.col("b")).alias("n_both"), F.count("*").alias("n_any"))
    return met.select("n_left", "n_right", "n_both", F.round(safe_rate(F.col("n_both"), F.col("n_any")), 6).alias("jaccard"))


def confusion(rows: DataFrame, keys: list[str], predicted: Column, truth: Column) -> DataFrame:
    """Per key: true and false positives and negatives, precision and recall over all rows (micro)."""
    out = rows.groupBy(*keys).agg(F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"), F.count_if(~predicted & truth).alias("fn"), F.count_if(~predicted & ~truth).alias("tn"))
    rate = lambda a, b: F.round(safe_rate(F.col(a), F.col(a) + F.col(b)), 6)
    return out.withColumns({"precision": rate("tp", "fp"), "recall": rate("tp", "fn")})
