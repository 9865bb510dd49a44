"""Calculation rollups: weighted children against their parent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate_rollup(parents: DataFrame, children: DataFrame, keys: Sequence[str], value: str, child_value: str, weight: str | None = None, share: float = 0.02, least: float = 1.0) -> DataFrame:
    """Parents with at least one child: the weighted sum of those, the difference, and valid or mismatch
    (beyond the larger of `share` of the parent and `least`). Children are summed before the join."""
    w = F.col(child_value) * F.col(weight) if weight else F.col(child_value)
    total = children.groupBy(*keys).agg(F.sum(w).alias("computed"), F.count("*").alias("n_children"))
    out = parents.join(total, list(keys)).withColumn("difference", F.abs(F.col(value) - F.col("computed")))
    return out.withColumn("status", F.when(F.col("difference") > F.greatest(share * F.abs(F.col(value)), F.lit(least)), "mismatch").otherwise("valid"))
