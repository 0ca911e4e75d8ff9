"""Usage by key and period as a stream whose state ends: every key has a timer at which its sums are given out and forgotten.

A key is a function and a period. Events are merged into its sums while they may still come, that is, until the watermark has
passed the period's end; then the timer fires, the sums are given out once, and nothing of the key is left in the state. So
the state holds the periods of the last ``late`` time only, however long the stream runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "function string, period timestamp, calls long, k long, batches long"


class PeriodSums(StatefulProcessor):
    """State of a key: calls, sum of ``k``, and the micro-batches that have added to it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "calls long, k long, batches long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls, k, batches, ends = 0, 0, 0, 0
        if self.sums.exists():
            calls, k, batches = self.sums.get()
        else:
            ends = -1
        for part in rows:
            calls, k = calls + len(part), k + int(part["k"].fillna(0).sum())
            if ends == -1:
                ends = int(part["ends"].iloc[0])
                self.handle.registerTimer(ends)
        self.sums.update((calls, k, batches + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        calls, k, batches = self.sums.get()
        self.sums.clear()
        yield pd.DataFrame({"function": [key[0]], "period": [key[1]], "calls": [calls], "k": [k], "batches": [batches]})

    def close(self) -> None:
        pass


def closed_periods(events: DataFrame, late: str, period: str = "1 day") -> DataFrame:
    """``function, period, calls, k, batches`` of a stream of ``ts, function, k``, each key once, when its period is over by more than ``late``.

    Events later than that behind the newest are left out, as their key is gone. The session's state store must be ``STORE``.
    """
    e = events.withWatermark("ts", late).withColumn("w", F.window("ts", period))
    e = e.select("ts", F.coalesce("function", F.lit("")).alias("function"), F.col("w.start").alias("period"), (F.unix_millis("w.end")).alias("ends"), "k")
    return e.groupBy("function", "period").transformWithStateInPandas(PeriodSums(), _OUT, "Append", "EventTime")


def run_closed(spark: SparkSession, events: DataFrame, table: str, checkpoint: str, late: str, period: str = "1 day") -> None:
    """Take in all that is there now and append the periods that close to ``table``; a later run goes on where this one ended."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        q = closed_periods(events, late, period).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", table)
        q.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
