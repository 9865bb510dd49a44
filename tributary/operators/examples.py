"""Retrieval of examples by the words that they share with a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_set(text: Column) -> Column:
    """Distinct words of ASCII letters and digits, lower case; none of a null text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)"))
    return F.array_distinct(F.transform(found, lambda w: F.lower(w)))


def similar_examples(rows: DataFrame, examples: DataFrame, row: str, example: str, least: float, k: int) -> DataFrame:
    """(row, example, n_shared, share, rank): the k examples that have most of a row's words, from `least` on.

    Both sides bring their key and an array `words`. A row of n words needs ceil(least * n) of them in an
    example, so one of its n - ceil(least * n) + 1 rarest words is there: only those are joined, and
    frequent words never are unless a row has nothing else. Every found pair is then decided on its
    whole sets. Ties go to the smaller key. Keys are unique on their side;
    rows without words, and either side's rows without a key, are in no pair.
    """
    need = F.ceil(F.size("words") * F.lit(least).cast("decimal(9,6)"))
    sized = rows.where(F.size("words") > 0).select(row, (F.size("words") - need + 1).alias("take"), F.explode("words").alias("w"))
    # words that no row has decide nothing: they are not moved
    spread = examples.select(example, F.explode("words").alias("w")).join(sized.select("w").distinct(), "w", "left_semi")
    own = spread.groupBy(example).agg(F.collect_list("w").alias("b"))
    seen = spread.groupBy("w").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy(row).orderBy(F.coalesce("df", F.lit(0)), "w")
    prefix = sized.join(seen, "w", "left").withColumn("place", F.row_number().over(rarest)).where("place <= take AND df > 0").select(row, "w")
    pairs = prefix.join(spread, "w").select(row, example).distinct()
    both = pairs.join(rows.select(row, F.col("words").alias("a")), row).join(own, example)
    n = F.size(F.array_intersect("a", "b")).cast("long")
    scored = both.select(row, example, n.alias("n_shared"), F.size("a").alias("n")).where(F.col("n_shared") >= F.ceil(F.col("n") * F.lit(least).cast("decimal(9,6)")))
    scored = scored.select(row, example, "n_shared", F.round(F.col("n_shared") / F.col("n"), 6).alias("share"))
    # the limit on the rank reaches each task before the shuffle
    best = Window.partitionBy(row).orderBy(F.desc("n_shared"), example)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))
