"""Overlaps of boxes on a page, by a join over grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many pairs of a cell a task should get, and into how many tasks they are dealt at most.
PAIRS_A_TASK, MOST_TASKS = 1_000_000, 2000


def overlaps(left: DataFrame, right: DataFrame, page: list[str], cell: float) -> DataFrame:
    """(page, left_id, right_id, area, share) of boxes that overlap; share is of the smaller area.

    Both sides bring the page's columns, id, x0, y0, x1, y1. A box is in every cell that it touches, so two
    that overlap meet; they are decided in one cell only, that of the corner where their common part
    begins, so no pair comes twice and nothing is made distinct. Boxes without an inside, or with a
    null, overlap nothing. `cell` should be about the size of a box: a box in n cells costs n rows.
    """
    at = lambda x: F.floor(F.col(x) / cell)

    def in_cells(df: DataFrame, side: str) -> DataFrame:
        good = df.where("x1 > x0 AND y1 > y0").select(*page, "id", "x0", "y0", "x1", "y1")
        rows = good.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))
        return rows.withColumnsRenamed({c: f"{side}_{c}" for c in ("id", "x0", "y0", "x1", "y1")})

    on = [*page, "cx", "cy"]
    mine, theirs = in_cells(left, "left"), in_cells(right, "right")
    # rows are few beside the pairs they make: the number of tasks is that of the pairs, and the cells are dealt by it
    n_pairs = mine.groupBy(*on).agg(F.count("*").alias("n")).join(theirs.groupBy(*on).agg(F.count("*").alias("m")), on).agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    tasks = max(1, min(MOST_TASKS, (n_pairs or 0) // PAIRS_A_TASK))
    met = mine.repartition(tasks, *on).join(theirs.repartition(tasks, *on), on)
    x0, y0, x1, y1 = F.greatest("left_x0", "right_x0"), F.greatest("left_y0", "right_y0"), F.least("left_x1", "right_x1"), F.least("left_y1", "right_y1")
    own = (F.floor(x0 / cell) == F.col("cx")) & (F.floor(y0 / cell) == F.col("cy"))
    size = lambda s: (F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0"))
    area = (x1 - x0) * (y1 - y0)
    return met.where(own & (x1 > x0) & (y1 > y0)).select(*page, "left_id", "right_id", area.alias("area"), (area / F.least(size("left"), size("right"))).alias("share"))
