"""Ranks, gaps, caps, merges and profiles of candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def ranked(df: DataFrame, group: Keys, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """1-based rank within the group; the order must end with a unique key."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))


def top_k(df: DataFrame, group: Keys, order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k of each group; the limit is pushed below the shuffle."""
    return ranked(df, group, order, out).where(F.col(out) <= k)


def with_gap(df: DataFrame, group: Keys, score: str, order: Sequence[Column], near: float = 0.05) -> DataFrame:
    """Lead of the first over the second, and whether that is too near to tell (both are flagged)."""
    w = Window.partitionBy(*group)
    df = df.withColumn("_next", F.lead(score).over(w.orderBy(*order))).withColumn("_place", F.row_number().over(w.orderBy(*order)))
    gap = F.max(F.when(F.col("_place") == 1, F.col(score) - F.col("_next"))).over(w)
    return df.withColumn("gap", gap).withColumn("ambiguous", (F.col("_place") <= 2) & F.coalesce(F.col("gap") <= near, F.lit(False))).drop("_next", "_place")


def capped_top_k(df: DataFrame, group: Keys, source: str, order: Sequence[Column], cap: int, k: int, out: str = "rank") -> DataFrame:
    """At most `cap` of each source and k in all: the same rows as a greedy pass in this order."""
    within = ranked(df, [*group, source], order, "_within").where(F.col("_within") <= cap)
    return ranked(within, group, order, out).where(F.col(out) <= k).drop("_within")


def latest_per_key(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """The last row of each key."""
    return top_k(df, keys, order, 1, "_place").drop("_place")


def first_per_key(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """The first of equal rows; the others are suppressed."""
    return top_k(df, keys, order, 1, "_place").drop("_place")


def merge_candidates(df: DataFrame, keys: Keys, source: str, score: str, risk: str, source_order: Sequence[str]) -> DataFrame:
    """Candidates of several sources as one: scores are folded in source order, each further source
    giving max(score so far, its score) plus min(.08, .025 * sources before it); the worst risk counts."""
    place = F.array_position(F.array(*map(F.lit, source_order)), F.col(source))
    rows = F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col(score).alias("s"), F.col(source).alias("n"))))
    fold = F.aggregate(
        F.col("_rows"),
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            F.when(a["n"] == 0, x["s"]).otherwise(F.least(F.lit(1.0), F.greatest(a["s"], x["s"]) + F.least(F.lit(0.08), F.lit(0.025) * a["n"]))).alias("s"),
            (a["n"] + 1).alias("n"),
        ),
    )
    out = df.groupBy(*keys).agg(rows.alias("_rows"), F.max(risk_order(F.col(risk))).alias("_risk"))
    return out.select(*keys, F.round(fold["s"], 4).alias("score"), fold["n"].cast("long").alias("n_sources"), F.transform("_rows", lambda x: x["n"]).alias("sources"), risk_name(F.col("_risk")).alias("risk"))


RISKS = ("low", "medium", "high", "critical")


def risk_order(risk: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, RISKS)), risk)


def risk_name(order: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RISKS)), order.cast("int"))


#: Weights of the parts of a candidate's evidence score.
EVIDENCE = {"similarity": 0.34, "family": 0.13, "section": 0.07, "role": 0.04, "source": 0.24, "template": 0.05, "memory": 0.05, "dictionary": 0.04, "note": 0.04}


def evidence_score(parts: dict[str, Column], prior: Column) -> Column:
    """Weighted evidence, and up to .1 for prior exact matches."""
    total = F.least(F.lit(0.1), prior)
    for name, part in parts.items():
        total = total + EVIDENCE[name] * part
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), total)), 4)


def mapping_decision(top: Column, gap: Column) -> Column:
    """mapped, ambiguous or abstain."""
    gap = F.coalesce(gap, F.lit(1.0))
    return F.when((top >= 0.70) & (gap >= 0.04), "mapped").when((top >= 0.60) & (gap < 0.04), "ambiguous").otherwise("abstain")


def advisory(df: DataFrame) -> DataFrame:
    """Nothing is applied by itself: the two columns that every candidate carries."""
    return df.withColumns({"requires_human_review": F.lit(True), "safe_for_auto_apply": F.lit(False)})


def profile_quality(coverage: Column, top1: Column, top3: Column, top5: Column, high: Column, ambiguous: Column) -> Column:
    """Quality of a ranking profile; all arguments are rates."""
    return F.round(22 * coverage + 34 * top1 + 20 * top3 + 14 * top5 + 8 * (1 - high) - 6 * ambiguous, 4)
