"""Context within a budget: the lists around a fixed part are cut, the least important first, until it fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def within_budget(items: DataFrame, fixed: DataFrame, key: str, limit: int, run: int = 4096) -> tuple[DataFrame, DataFrame]:
    """What fits into `limit` beside the fixed part of a key: (kept items, summary of each key).

    items: key, priority (1 goes last), place (in its list, unique with the priority in a key), size.
    fixed: key, size. Items go from the end of the least important list on, one by one, so what stays is
    the longest run of items, by priority and place, whose sizes sum up to no more than is left. The sums
    are taken in two steps, of runs of `run` places and within a run, so a key of any size is spread over
    its runs. summary: key, fits (false: the fixed part alone is too large, and nothing is kept), used,
    kept, omitted, truncated. A null size counts 0; items of a key without a fixed part have all of
    the limit; items without a key are left out.
    """
    rows = items.where(F.col(key).isNotNull()).withColumns({"size": F.coalesce("size", F.lit(0)).cast("long"), "run": F.floor(F.col("place") / run)})
    base = fixed.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(F.coalesce("size", F.lit(0))).cast("long").alias("fixed"))
    runs = rows.groupBy(key, "priority", "run").agg(F.sum("size").alias("whole"))
    order = Window.partitionBy(key).orderBy("priority", "run")
    runs = runs.withColumn("before", F.coalesce(F.sum("whole").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("whole")
    inside = Window.partitionBy(key, "priority", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumn("inside", F.sum("size").over(inside)).join(runs, [key, "priority", "run"]).join(base, key, "left")
    fits = F.coalesce("fixed", F.lit(0)) + F.col("before") + F.col("inside") <= limit
    told = sums.withColumn("kept", fits)
    kept = told.where("kept").drop("run", "before", "inside", "fixed", "kept")
    counts = told.groupBy(key).agg(F.sum(F.when(F.col("kept"), F.col("size")).otherwise(0)).alias("used"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("omitted"))
    summary = base.join(counts, key, "full").select(
        key, (F.coalesce("fixed", F.lit(0)) <= limit).alias("fits"), (F.coalesce("fixed", F.lit(0)) + F.coalesce("used", F.lit(0))).alias("used"),
        F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("omitted", F.lit(0)).alias("omitted"), (F.coalesce("omitted", F.lit(0)) > 0).alias("truncated"),
    )
    return kept, summary
