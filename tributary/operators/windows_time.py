"""Event-time windows and sessions, for batch and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], value: str) -> DataFrame:
    """Rows, sum and largest value per window and key."""
    out = df.groupBy(F.window(F.col(ts).cast("timestamp"), size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, "n", "total", "largest")


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str]) -> DataFrame:
    """Sessions: rows of a key with less than `gap` between neighbours."""
    out = df.groupBy(F.session_window(F.col(ts).cast("timestamp"), gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.max(F.col(ts).cast("timestamp")).alias("last"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("last").cast("timestamp_ntz").alias("session_end"), *keys, "n")
