"""Review queues, validation thresholds, set comparisons and best matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of priorities, any other one is 9; least shares of reviewed, tagged and valued items.
PRIORITIES = {"critical": 0, "high": 1, "medium": 2, "low": 3}
OTHER = 9
LEAST_REVIEWED, LEAST_TAGGED, LEAST_VALUED = 0.5, 0.3, 0.5


def priority_rank(priority: Column) -> Column:
    out = F.lit(OTHER)
    for name, rank in PRIORITIES.items():
        out = F.when(priority == name, F.lit(rank)).otherwise(out)
    return out


def validation(items: DataFrame, key: str, reviewed: Column, tagged: Column, valued: Column) -> DataFrame:
    """Per key: counts, and the warnings of what too few of its items have."""
    own = items.groupBy(key).agg(F.count("*").alias("n"), *(F.count_if(c).alias(x) for c, x in ((reviewed, "n_reviewed"), (tagged, "n_tagged"), (valued, "n_valued"))))
    low = [F.when(F.col(c) < share * F.col("n"), F.lit(name)) for c, share, name in (("n_reviewed", LEAST_REVIEWED, "reviewed"), ("n_tagged", LEAST_TAGGED, "tagged"), ("n_valued", LEAST_VALUED, "valued"))]
    return own.withColumn("warnings", F.array_compact(F.array(*low)))


def compared_sets(expected: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of either side, once, with the side that has it: both, missing (expected only) or extra."""
    a, b = (x.select(*keys).distinct() for x in (expected, predicted))
    met = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), keys, "full")
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "missing").otherwise("extra")
    return met.select(*keys, side.alias("side"))


def best_match(candidates: DataFrame, key: str, score: str, place: str, least: float) -> DataFrame:
    """Per key, the first candidate (by place) with the largest score, if that is above the threshold."""
    best = F.max(F.struct(F.col(score).alias("score"), (-F.col(place)).alias("at")))
    own = candidates.groupBy(key).agg(best.alias("b"))
    return own.where(F.col("b.score") > least).select(key, (-F.col("b.at")).alias("place"), F.col("b.score").alias("score"))
