"""Matching-block similarity, for which Spark has no function: Arrow-batched, on distinct pairs only."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tributary.functions.labels import jaccard, normalize_label, tokens


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / T over matching blocks."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def with_ratio(df: DataFrame, left: str, right: str, out: str = "ratio") -> DataFrame:
    """df with the ratio of two columns, computed once for each distinct pair and joined back."""
    pairs = df.select(F.col(left).alias("_l"), F.col(right).alias("_r")).distinct().withColumn(out, ratio("_l", "_r"))
    return df.join(pairs, df[left].eqNullSafe(pairs["_l"]) & df[right].eqNullSafe(pairs["_r"])).drop("_l", "_r")


def ratio_bound(a: Column, b: Column) -> Column:
    """No ratio exceeds this: a cheap filter before the Python function."""
    return F.when(F.length(a) + F.length(b) == 0, F.lit(1.0)).otherwise(2 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b)))


def label_similarity(df: DataFrame, left: str, right: str, out: str = "similarity") -> DataFrame:
    """df with the similarity of two labels and why: exact 1; one within the other max(.82, ratio of their
    lengths); else the larger of ratio and token overlap. Only undecided distinct pairs reach Python."""
    pairs = df.select(F.col(left).alias("_l"), F.col(right).alias("_r")).distinct()
    pairs = pairs.select("*", normalize_label(F.col("_l")).alias("_a"), normalize_label(F.col("_r")).alias("_b"))
    within = (F.length("_a") > 0) & (F.length("_b") > 0) & (F.col("_a").contains(F.col("_b")) | F.col("_b").contains(F.col("_a")))
    length = F.least(F.length("_a"), F.length("_b")) / F.greatest(F.length("_a"), F.length("_b"))
    known = F.when(F.col("_a") == F.col("_b"), F.lit(1.0)).when(within, F.greatest(F.lit(0.82), length))
    pairs = pairs.withColumns({"_known": known, "_why": F.when(F.col("_a") == F.col("_b"), "exact").when(within, "contains").otherwise("fuzzy")})
    done = pairs.where("_known is not null").withColumn(out, F.round("_known", 4))
    rest = pairs.where("_known is null").withColumn(out, F.round(F.greatest(ratio("_a", "_b"), jaccard(tokens(F.col("_a")), tokens(F.col("_b")))), 4))
    found = done.union(rest).select("_l", "_r", out, F.col("_why").alias(f"{out}_reason"))
    return df.join(found, df[left].eqNullSafe(found["_l"]) & df[right].eqNullSafe(found["_r"])).drop("_l", "_r")
