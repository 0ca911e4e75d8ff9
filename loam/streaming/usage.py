"""Structured Streaming: additive usage, debounced events and sliding sums.

Every function takes a streaming or a batch DataFrame, so that a stream's result can be checked against its batch twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def period_counts(events: DataFrame, late: str | None = None) -> DataFrame:
    """Calls per function and day. An event is merged into its day however late it comes, as state is kept for every day; a caller
    that gives ``late`` bounds the state, and gives up events later than that behind the newest."""
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", "1 day").alias("w"), "function").agg(F.count(F.lit(1)).alias("calls"), F.sum("k").alias("k"))


def debounced(events: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """One row per burst of a key: the session window of ``gap`` with its last event and the number of events."""
    e = events.withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.count(F.lit(1)).alias("events"))


def collected(events: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """All events of each burst, in order."""
    e = events.withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.array_sort(F.collect_list("event_id")).alias("ids"))


def sliding(events: DataFrame, width: str, step: str, late: str = "2 days") -> DataFrame:
    """Counts over sliding windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))


def read_events(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream of its files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A file source watches a folder; a table that is one file is matched by name from its folder.
    folder, glob = (sf_dir, "events.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)
    return stream.select("event_id", F.col("user_id").alias("service"), F.col("event_type").alias("function"), F.col("ts").cast("timestamp").alias("ts"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def ingest(events: DataFrame, symbols: DataFrame, table: str, quarantine: str, checkpoint: str, once: bool = True):
    """Match micro-batches and append per-batch sums by symbol and period; what matches nothing goes to ``quarantine``.

    Each batch overwrites its own ``batch`` partition, so a batch that is replayed after a failure counts once; readers sum over
    batches (:func:`usage_state`).
    """

    def save(batch: DataFrame, number: int) -> None:
        matched = batch.join(symbols, batch["function"] == symbols["name"], "left")
        good = matched.where("symbol_id is not null").groupBy("symbol_id", F.date_format("ts", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("calls"))
        good.write.mode("overwrite").parquet(f"{table}/batch={number}")
        matched.where("symbol_id is null").select("event_id", "function").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    writer = events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def usage_state(spark: SparkSession, table: str) -> DataFrame:
    """Sums over all batches."""
    return spark.read.option("basePath", table).parquet(table).groupBy("symbol_id", "period").agg(F.sum("calls").alias("calls"))
