"""Mixing sources to target weights by subset-sum budget fitting.

1. Documents are counted by exact length in words; sources in code-point order (null last) get the
   weights 3, 1, 2, repeating, and share ``SHARE`` of all words. A target never exceeds twice its
   source's words; the excess goes to the others by weight (water filling, in closed form).
2. A source is taken whole as often as its target allows; a budget of less than its size remains.
3. Seeded choice: documents lie on a line by a hash of their id. Histograms of that line, level by
   level, find the place up to which documents are taken until at most ``POOL`` documents lie in the
   cell that crosses the budget. Each level sums before the shuffle and leaves ``2 ** BITS`` rows a source.
4. Documents of that cell are counted by exact length, and a bounded-knapsack dynamic programme says
   how many of each length come closest to the remaining budget; within a length the seed chooses.
   Sums are the bits of an integer, so they are exact however long the documents: a budget is less
   than the words of ``POOL`` documents, and takes a few bits a word.

Defined cases: null text has size 0 and takes nothing; null sources are a source of their own; an
empty source (no words) has target 0; rows that repeat a doc_id lie at one place and are chosen by size
there; an empty table gives an empty mix. The seed is a parameter; reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.shared import saved

SHARE = 1.5
WEIGHTS = (3, 1, 2)
MOST = 2
POOL = 256
BITS = 5
LEVELS = 12
SEED = 20_240_131


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): one row per source, of a table that has one row per document."""
    own = saved(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    everything = Window.partitionBy(F.lit(0))  # over one row per source
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))).withColumn("most", most * F.col("source_size"))
    upto = everything.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(upto), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    # sources in the order in which they fill up; the first that doesn't sets the level of all others
    rows = rows.withColumn("level", F.when(F.col("most") >= level * F.col("weight"), level))
    order = everything.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_first())
    rows = rows.withColumn("reached", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    final = F.min("level").over(everything)
    return rows.select("source", "source_size", F.when(F.col("reached").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.coalesce("reached", final) * F.col("weight"))).alias("target"))


def reached(parts: list[int], start: int, step: Callable[[int, int], int]) -> int:
    """A bit for each sum that some of the parts lead to from `start`; step adds a part to all of them."""
    for x in parts:
        start |= step(start, x)
    return start


def subset(parts: list[int], total: int) -> list[bool]:
    """Which of the parts sum to `total`, a sum that some of them have.

    One half of the parts leads up from 0, the other down from the total; where they meet, each half has a
    total of its own. Memory: two bits a sum.
    """
    if len(parts) == 1:
        return [total > 0]
    half = len(parts) // 2
    low, high = parts[:half], parts[half:]
    mask = (1 << (total + 1)) - 1
    met = reached(low, 1, lambda bits, x: (bits << x) & mask) & reached(high, 1 << total, lambda bits, x: bits >> x)
    at = (met & -met).bit_length() - 1  # the smallest
    return subset(low, at) + subset(high, total - at)


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum is as near below the budget as can be: exact, whatever the budget."""
    taken = np.zeros(len(lengths), np.int64)
    if int((lengths * counts).sum()) <= budget:
        return counts.astype(np.int64)
    parts: list[tuple[int, int]] = []  # (place of the length, how many at once): 1, 2, 4, ... and the rest
    for i, (size, n) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        k = 1
        while size and n > 0:
            if size * min(k, n) <= budget:
                parts.append((i, min(k, n)))
            n -= k
            k *= 2
    sums = [int(lengths[i]) * k for i, k in parts]
    mask = (1 << (budget + 1)) - 1
    total = reached(sums, 1, lambda bits, x: (bits << x) & mask).bit_length() - 1
    if total > 0:
        for (i, k), used in zip(parts, subset(sums, total), strict=True):
            taken[i] += k * used
    return taken


def cells(rows: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """One level further: of each source's open cell, the part that crosses what is left of the budget."""
    width = 1 << (BITS * (LEVELS - level - 1))
    inside = rows.join(state, rows["source"].eqNullSafe(state["_source"])).where((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")) & (F.col("n") > POOL))
    bins = inside.groupBy("_source", F.floor((F.col("place") - F.col("lo")) / F.lit(width)).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"), F.first("lo").alias("lo"), F.first("left").alias("left"))
    upto = F.sum("words").over(Window.partitionBy("_source").orderBy("bin"))
    bins = bins.withColumn("before", upto - F.col("words")).where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left")))
    found = bins.select(
        F.col("_source").alias("_s"),
        (F.col("lo") + F.col("bin") * width).alias("new_lo"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("new_hi"),
        (F.col("left") - F.col("before")).alias("new_left"),
        F.col("docs").alias("new_n"),
    )
    return state.join(found, state["_source"].eqNullSafe(found["_s"]), "left").select(
        "_source", "source_size", "target", "times", *(F.coalesce(f"new_{c}", c).alias(c) for c in ("lo", "hi", "left", "n"))
    )


def mix(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, key: str = "doc_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """Of a table with `key`, source and size: these, with source_size, target, taken and times, and the carried columns."""
    span = 1 << (BITS * LEVELS)
    rows = saved(docs.select(key, "source", "size", *carried, F.pmod(F.xxhash64(F.lit(seed), key), F.lit(span)).alias("place")), "lengths")
    own = targets(rows, share, weights, most)
    counts = rows.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "_c")
    times = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    state = own.join(counts, own["source"].eqNullSafe(counts["_c"])).select(F.col("source").alias("_source"), "source_size", "target", times.cast("long").alias("times"), F.lit(0).cast("long").alias("lo"), F.lit(span).cast("long").alias("hi"), "n")
    # nothing is left where a source is taken as often as it may be
    state = saved(state.withColumn("left", F.when(F.col("times") < most, F.round(F.col("target") - F.col("times") * F.col("source_size"))).otherwise(0).cast("long")).withColumn("n", F.when(F.col("left") > 0, F.col("n")).otherwise(0)).withColumn("hi", F.when(F.col("left") > 0, F.col("hi")).otherwise(0)), "state")
    for level in range(LEVELS):
        if not state.where(F.col("n") > POOL).limit(1).count():
            break
        state = saved(cells(rows, state, level), "state")
    met = rows.join(state, rows["source"].eqNullSafe(state["_source"]))
    pool = met.where((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")))
    lengths = pool.groupBy("_source", "size").agg(F.count("*").alias("n"), F.first("left").alias("left"))

    def best(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("size")
        k = fit(own["size"].to_numpy(), own["n"].to_numpy(), int(own["left"].iloc[0]))
        return pd.DataFrame({"_s": own["_source"], "_size": own["size"], "_k": k})

    kind = rows.schema["source"].dataType.simpleString()
    chosen = lengths.groupBy("_source").applyInPandas(best, f"_s {kind}, _size long, _k long")
    order = F.row_number().over(Window.partitionBy("_source", "size").orderBy("place", key, *(F.xxhash64(c) for c in carried)))
    ranked = pool.withColumn("_rank", order)
    picked = ranked.join(chosen, ranked["_source"].eqNullSafe(chosen["_s"]) & (ranked["size"] == chosen["_size"]), "left").withColumn("more", (F.coalesce("_k", F.lit(0)) >= F.col("_rank")).cast("long"))
    rest = met.where((F.col("place") < F.col("lo")) | (F.col("place") >= F.col("hi"))).withColumn("more", (F.col("place") < F.col("lo")).cast("long"))
    out = [x.select(key, "source", "size", "source_size", "target", *carried, (F.col("times") + F.col("more")).alias("times")) for x in (picked, rest)]
    return out[0].union(out[1]).withColumn("taken", F.col("times") * F.col("size"))


def op8(docs: DataFrame) -> DataFrame:
    return mix(with_sizes(docs.select("doc_id", "source", "text"))).select("doc_id", "size", "source_size", "target", "taken", "times")


def stage(docs: DataFrame) -> DataFrame:
    """The mix: each document that is taken, once, with how often (``times``) and what the contract gives.

    Rows with null or repeated ids are rows like others; columns that clash with the added ones are replaced.
    """
    added = ["size", "source_size", "target", "taken", "times"]
    own = docs.drop(*added)
    # the whole row goes through the mix: a doc_id may be null or occur again
    sized = with_sizes(own.select("doc_id", "source", "text", F.struct(*own.columns).alias("_whole"))).drop("text")
    return mix(sized, carried=("_whole",)).where("times > 0").select("_whole.*", *added)
