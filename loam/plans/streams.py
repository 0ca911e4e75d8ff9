"""Batch twins of the streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loam.functions import files
from loam.functions.shared import shared_dir
from loam.plans.catalog import query
from loam.sources import polling
from loam.sources import relations as R
from loam.streaming import usage


@query(R.using("calls") + "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, function, count(*) AS calls, CAST(sum(k) AS BIGINT) AS k FROM calls GROUP BY 1, 2")
def stream_usage(spark, sf_dir):
    return usage.period_counts(R.calls(spark, sf_dir)).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "function", "calls", "k")


_SESSION = "g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY service ORDER BY ts, event_id), ts) < 1800000000 THEN 0 ELSE 1 END AS s FROM calls), n AS (SELECT *, sum(s) OVER (PARTITION BY service ORDER BY ts, event_id) AS b FROM g)"


@query(R.using("calls") + f", {_SESSION} SELECT service, arg_max(event_id, (ts, event_id)) AS last_event, count(*) AS events FROM n GROUP BY service, b")
def stream_debounce_session(spark, sf_dir):
    return usage.debounced(R.calls(spark, sf_dir), "service", "30 minutes").select("service", "last_event", "events")


@query(R.using("calls") + f", {_SESSION} SELECT service, array_to_string(list_sort(list(event_id)), ',') AS ids FROM n GROUP BY service, b")
def stream_batch_debounce(spark, sf_dir):
    return usage.collected(R.calls(spark, sf_dir), "service", "30 minutes").select("service", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(R.using("calls") + ", w AS (SELECT date_trunc('day', ts) - to_hours(12 * i) + to_hours(CASE WHEN hour(ts) >= 12 THEN 12 ELSE 0 END) AS start, value FROM calls, unnest(range(0, 2)) AS t(i)) SELECT strftime(start, '%Y-%m-%d %H') AS start, count(*) AS events, round(sum(value), 4) AS total FROM w GROUP BY 1")
def stream_sliding_day(spark, sf_dir):
    return usage.sliding(R.calls(spark, sf_dir), "24 hours", "12 hours").select(F.date_format("w.start", "yyyy-MM-dd HH").alias("start"), "events", "total")


@query(
    "WITH b AS (SELECT p_brand || '.txt' AS path, starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#2') AS old, starts_with(p_brand, 'Brand#2') OR starts_with(p_brand, 'Brand#3') AS new FROM part GROUP BY p_brand) "
    "SELECT 1::BIGINT AS poll, path, 'created' AS change FROM b WHERE old UNION ALL SELECT 2, path, CASE WHEN NOT new THEN 'removed' WHEN old THEN 'changed' ELSE 'created' END FROM b WHERE old OR new"
)
def poll_stream(spark, sf_dir):
    """A folder of one file a brand, polled as a stream before and after some come, change and go; each run goes on where the last one ended."""
    polling.register(spark)
    at = f"{shared_dir(spark)}/loam-polled-{uuid.uuid4().hex}"
    by = R.read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("sizes"))
    brands = by.collect()  # a row a brand

    def poll() -> None:
        changes = spark.readStream.format("loam-poll").option("path", f"{at}/watched").option("log", f"{at}/log").load()
        q = changes.writeStream.format("parquet").option("path", f"{at}/changes").option("checkpointLocation", f"{at}/progress").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    for heads, what in ((("Brand#1", "Brand#2"), "n"), (("Brand#2", "Brand#3"), "sizes")):
        for r in brands:
            path = f"{at}/watched/{r['p_brand']}.txt"
            files.delete(spark, path)
            if r["p_brand"].startswith(heads):
                files.create_text(spark, path, f"{what} {r[what]}")
        poll()
    return spark.read.parquet(f"{at}/changes").select("poll", "path", "change")
