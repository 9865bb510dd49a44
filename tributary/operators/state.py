"""State over events: legal transitions, and the machine that ends once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transitions(df: DataFrame, key: Sequence[str], order: Sequence[str], state: str, allowed: Sequence[tuple[str, str]]) -> DataFrame:
    """Each row with the state before it and whether that step is allowed (a first state always is)."""
    df = df.withColumn("previous", F.lag(state).over(Window.partitionBy(*key).orderBy(*order)))
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, b in allowed))
    return df.withColumn("legal", F.col("previous").isNull() | F.array_contains(pairs, F.concat_ws(">", "previous", state)))


def terminal_once(df: DataFrame, key: Sequence[str], order: Sequence[str], is_terminal: str) -> DataFrame:
    """The rows up to the first terminal one, with a sequence number; what comes later is rejected."""
    w = Window.partitionBy(*key).orderBy(*order)
    ended = F.coalesce(F.max(F.col(is_terminal).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    return df.withColumn("accepted", ~ended).withColumn("sequence", F.when(F.col("accepted"), F.row_number().over(w)).cast("long"))


def hierarchy_paths(edges: DataFrame, levels: int, parent: str = "parent", child: str = "child", order: str = "ord") -> DataFrame:
    """Paths from the roots of an edge table, in depth-first order of `path`, down to `levels`.
    One join per level: hierarchies of concepts are shallow, and their depth is a parameter."""
    roots = edges.select(F.col(parent).alias("node")).distinct().join(edges.select(F.col(child).alias("node")), "node", "left_anti")
    level = roots.select("node", F.col("node").cast("string").alias("path"), F.lit(0).cast("long").alias("depth"))
    out = level
    for _ in range(levels):
        level = level.join(edges, level["node"] == edges[parent]).select(F.col(child).alias("node"), F.concat("path", F.lit("/"), F.lpad(F.col(order).cast("string"), 6, "0")).alias("path"), (F.col("depth") + 1).alias("depth"))
        out = out.union(level)
    return out
