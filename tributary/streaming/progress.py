"""Progress of jobs as a stateful stream: the last event of a key stands until its time to live is over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tributary.sources.shared import new_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastWrite(StatefulProcessor):
    """State: the last (ts, event) of a key, in milliseconds of event time. A timer ends it ttl after that.

    Of events at one millisecond the one with the larger id stands. An event older than what is held
    changes nothing; one that comes after the end begins anew.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, event_id long, status string")

    def row(self, key, held, state: str) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "ms": [held[0]], "event_id": [held[1]], "status": [held[2]], "state": [state]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        new = held
        for frame in rows:
            top = frame.sort_values(["ms", "event_id"]).iloc[-1]
            found = (int(top["ms"]), int(top["event_id"]), str(top["status"]))
            if new is None or found[:2] > tuple(new)[:2]:
                new = found
        if held is None or tuple(new) != tuple(held):
            if held is not None:
                self.handle.deleteTimer(held[0] + self.ttl_ms)
            self.last.update(tuple(new))
            self.handle.registerTimer(new[0] + self.ttl_ms)
            yield self.row(key, new, "live")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            yield self.row(key, self.last.get(), "expired")
            self.last.clear()

    def close(self) -> None:
        pass


def progress(events: DataFrame, key: str, ts: str, event_id: str, status: str, late: str, ttl_ms: int) -> DataFrame:
    """(key, ms, event_id, status, state) in update mode: live when a key's last event changes, expired at its end."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.unix_millis(ts).alias("ms"), F.col(event_id).cast("long").alias("event_id"), F.col(status).cast("string").alias("status"))
    out = "key string, ms long, event_id long, status string, state string"
    return rows.where("key IS NOT NULL").withWatermark("ts", late).groupBy("key").transformWithStateInPandas(LastWrite(ttl_ms), out, "Update", "EventTime")


def run_to_the_end(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """All that the stream gives for what there is now (``availableNow``), as a table."""
    at = new_folder(spark, name)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        # a file sink appends only: every batch's updates are written as they come
        sink = stream.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
        run = sink.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(f"{at}/rows")).start()
        run.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def state_of(rows: DataFrame) -> DataFrame:
    """Per key the last of what a stream of ``progress`` gave."""
    order = F.struct("ms", "event_id", (F.col("state") == "expired").alias("ended"))
    return rows.groupBy("key").agg(F.max_by(F.struct("ms", "event_id", "status", "state"), order).alias("s")).select("key", "s.*")
