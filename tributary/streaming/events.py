"""Streams of events: windows with a watermark, latest state, and the machine that ends once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, ts: str, size: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Count and sum per event-time window; rows later than the watermark are dropped."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key (output mode complete or update): last write wins."""
    names = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("s")).select(*keys, "s.*")


def terminal_once(events: DataFrame, key: str, ts: str, state: str, terminal: list[str], late: str = "10 minutes") -> DataFrame:
    """Accepted events with a sequence number; after a terminal one the key takes no more.

    State per key is a counter and a flag, and goes an hour of event time after the last event."""
    schema = f"{key} {events.schema[key].dataType.simpleString()}, {ts} timestamp, {state} string, sequence long"

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        n, ended = held.get if held.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values([ts, state])
        out = []
        for r in rows.itertuples():
            if ended:
                break
            n += 1
            out.append((k[0], getattr(r, ts), getattr(r, state), n))
            ended = getattr(r, state) in terminal
        held.update((n, ended))
        held.setTimeoutTimestamp(max(int(rows[ts].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + 3_600_000)
        yield pd.DataFrame(out, columns=[key, ts, state, "sequence"])

    return events.select(key, ts, state).withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, schema, "n long, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)
