"""Rules: induction, conflicts, replay, leave-one-out, and rates over any slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.labels import safe_rate


def tier(support: Column, folds: Column, conflicted: Column) -> Column:
    """strong, usable, weak or excluded, by support, folds that support it, and conflicts."""
    return F.when(conflicted & (support < 10), "excluded").when((support >= 10) & (folds >= 3) & ~conflicted, "strong").when((support >= 3) & (folds >= 2), "usable").otherwise("weak")


def induce(observations: DataFrame, pattern: Sequence[str], target: str, fold: str) -> DataFrame:
    """A rule per pattern: its most frequent target (ties to the smallest), support, folds, conflicts, tier."""
    by_target = observations.groupBy(*pattern, target).agg(F.count("*").alias("support"), F.count_distinct(fold).alias("folds"))
    w = Window.partitionBy(*pattern)
    ranked = by_target.withColumns({"_place": F.row_number().over(w.orderBy(F.desc("support"), target)), "n_targets": F.count("*").over(w), "total": F.sum("support").over(w)})
    best = ranked.where("_place = 1").drop("_place")
    return best.withColumn("precision", F.round(F.col("support") / F.col("total"), 6)).withColumn("tier", tier(F.col("support"), F.col("folds"), F.col("n_targets") > 1))


def leave_one_out(observations: DataFrame, pattern: Sequence[str], target: str, fold: str, least: int = 2) -> DataFrame:
    """Per fold: rules from all other folds replayed on it. Counts without a fold are the total less the
    fold's own, so no row is repeated per fold."""
    total = observations.groupBy(*pattern, target).agg(F.count("*").alias("n"))
    own = observations.groupBy(fold, *pattern, target).agg(F.count("*").alias("own"))
    patterns = own.select(fold, *pattern).distinct()
    rest = patterns.join(total, list(pattern)).join(own, [fold, *pattern, target], "left").withColumn("support", F.col("n") - F.coalesce("own", F.lit(0))).where(F.col("support") >= least)
    w = Window.partitionBy(fold, *pattern).orderBy(F.desc("support"), target)
    rules = rest.withColumn("_place", F.row_number().over(w)).where("_place = 1").select(fold, *pattern, F.col(target).alias("predicted"))
    replay = own.join(rules, [fold, *pattern], "left")
    out = replay.groupBy(fold).agg(
        F.sum("own").alias("observations"),
        F.sum(F.when(F.col("predicted").isNotNull(), F.col("own")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("predicted") == F.col(target), F.col("own")).otherwise(0)).alias("correct"),
    )
    return out.withColumns({"coverage": F.round(safe_rate(F.col("predicted"), F.col("observations"), 0.0), 6), "precision": F.round(safe_rate(F.col("correct"), F.col("predicted"), 0.0), 6)})


def replay_stage(label: Column, family: Column, period: Column, context: Column) -> Column:
    """The first stage at which a rule doesn't hold; matched if all do."""
    return F.when(~label, "label").when(~family, "family").when(~period, "period").when(~context, "context").otherwise("matched")


def harden(false_positives: Column, precision: Column, support: Column, conflicted: Column) -> Column:
    """What a rule may be used for."""
    return F.when(false_positives >= 2, "exclude").when(conflicted, "review").when((precision >= 0.95) & (support >= 3), "active").when(precision >= 0.90, "review").otherwise("exclude")


def sliced_rates(df: DataFrame, slices: Sequence[str], covered: Column, good: Column) -> DataFrame:
    """Coverage and precision over each slice and over all rows, in one pass of grouping sets."""
    sets = [[], *([s] for s in slices)]
    rows = df.select(*slices, covered.alias("_c"), good.alias("_g"))
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, slices)).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"), F.count_if("_c").alias("covered"), F.count_if(F.col("_c") & F.col("_g")).alias("good")
    )
    names = F.coalesce(*(F.when(F.col("gid") == (2 ** len(slices) - 1) - 2 ** (len(slices) - 1 - i), F.lit(s)) for i, s in enumerate(slices)), F.lit("all"))
    value = F.coalesce(*(F.when(F.col("gid") == (2 ** len(slices) - 1) - 2 ** (len(slices) - 1 - i), F.col(s).cast("string")) for i, s in enumerate(slices)))
    return out.select(names.alias("slice"), value.alias("value"), "n", F.round(safe_rate(F.col("covered"), F.col("n"), 0.0), 6).alias("coverage"), F.round(safe_rate(F.col("good"), F.col("covered"), 0.0), 6).alias("precision"))


def ranking_metrics(df: DataFrame, row: str, rank: str, hit: Column, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Rows, and the rate of rows with a hit within the first k, for each k."""
    per = df.groupBy(row).agg(F.min(F.when(hit, F.col(rank))).alias("first"))
    return per.agg(F.count("*").alias("rows"), *(F.round(F.avg((F.coalesce(F.col("first"), F.lit(1 << 30)) <= k).cast("double")), 6).alias(f"top{k}") for k in ks))
