"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.shared import release, saved

#: Edges for a task of a round: the tables are narrow, and a task that writes a handful of rows only costs time.
PER_TASK = 20_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): of every node in an edge, the smallest node that it reaches.

    Each round takes the smallest label among a node's neighbours, then the label of that label; the
    table of labels is written out, so lineage stays short. Only counts of rows go to the driver: of
    changes, and of edges, by which the rounds are dealt to as many tasks as the table is worth.
    Edges may repeat and may join a node with itself; nulls are left out.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = saved(edges.union(edges.select("v", "u")).distinct(), "edges")
    tasks = 1 + both.count() // PER_TASK
    labels = saved(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("component")).coalesce(tasks), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("near"))
        step = labels.select("node", "component").join(near, F.col("node") == F.col("u")).select("node", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        new = saved(step.join(jump, "next").select("node", F.least("next", "further").alias("component"), "was").coalesce(tasks), "labels")
        changed = new.where(F.col("component") < F.col("was")).limit(1).count()
        release(labels)
        labels = new
        if not changed:
            release(both)
            return labels.select("node", "component")
