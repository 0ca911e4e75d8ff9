"""Streams that end their state, and a polled folder as a stream."""

import os

from pyspark.sql import functions as F

from loam.sources import polling
from loam.sources import relations as R
from loam.streaming import expiring

SF = "/root/testdata/sf0.001"


def _calls(spark, path):
    return spark.readStream.schema("event_id long, ts timestamp, function string, k long").option("maxFilesPerTrigger", 1).parquet(path)


def _file(rows, folder, name):
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}-tmp")
    part = next(f for f in os.listdir(f"{folder}-tmp") if f.startswith("part-"))
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{folder}-tmp/{part}", f"{folder}/{name}.parquet")


def _closed(rows, late_days):
    """Days that are over by more than the delay, of all events."""
    newest = rows.agg(F.max("ts")).first()[0]
    by = rows.groupBy("function", F.date_trunc("day", "ts").alias("period")).agg(F.count(F.lit(1)).alias("calls"), F.sum("k").alias("k"))
    return {(r["function"], r["period"]): (r["calls"], r["k"]) for r in by.where((F.unix_seconds("period") + 86400 * (1 + late_days)) <= F.unix_seconds(F.lit(newest))).collect()}


def test_state_ends_and_late_events_merge(spark, tmp_path):
    """Three files, each with some events of the days before; a restart between them; days leave the state once they are given out."""
    e = R.calls(spark, SF).select("event_id", "ts", "function", "k").cache()
    day = F.dayofmonth("ts")
    late = F.col("event_id") % 7 == 0
    waves = [e.where(((day <= 10) & ~late)), e.where(((day <= 10) & late) | ((day > 10) & (day <= 12) & ~late)), e.where(((day > 10) & (day <= 12) & late) | (day > 12))]
    src, table, progress = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/progress"
    for i, rows in enumerate(waves):
        _file(rows, src, f"{i}")
        expiring.run_closed(spark, _calls(spark, src), table, progress, "12 days")  # each run is a restart from the checkpoint
    got = {(r["function"], r["period"]): (r["calls"], r["k"]) for r in spark.read.parquet(table).collect()}
    assert got == _closed(e, 12) and len(got) > 20
    assert spark.read.parquet(table).count() == len(got)
    assert max(r["batches"] for r in spark.read.parquet(table).collect()) >= 2  # late files were merged
    state = spark.read.format("statestore").option("stateVarName", "sums").load(progress)
    left = {r["key"]["period"] for r in state.select("key").collect()}
    assert left and not left & {p for _, p in got}


def test_too_late_events_are_left_out(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([(i, t, f, k) for i, (t, f, k) in enumerate(r)], "event_id long, ts string, function string, k long").withColumn("ts", F.col("ts").cast("timestamp"))
    src = f"{tmp_path}/in"
    for i, r in enumerate([rows(("2024-03-01 05:00", "f", 1), ("2024-03-01 06:00", "f", None)), rows(("2024-03-09 00:00", "g", 5)), rows(("2024-03-01 07:00", "f", 9), ("2024-03-08 07:00", "f", 4), ("2024-03-20 07:00", None, 4))]):
        _file(r, src, f"{i}")
        expiring.run_closed(spark, _calls(spark, src), f"{tmp_path}/out", f"{tmp_path}/p", "2 days")
    got = sorted((r["function"], str(r["period"])[:10], r["calls"], r["k"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("f", "2024-03-01", 2, 1), ("f", "2024-03-08", 1, 4), ("g", "2024-03-09", 1, 5)]


def test_a_polled_folder_gives_each_change_once(spark, tmp_path):
    polling.register(spark)
    folder, out = f"{tmp_path}/watched", f"{tmp_path}/changes"

    def put(name, text):
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)

    def poll():
        df = spark.readStream.format("loam-poll").option("path", folder).option("log", f"{tmp_path}/log").option("ignore", "*.tmp node_modules").load()
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/progress").trigger(processingTime="1 second").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    put("a.go", "1")
    put("b/c.go", "1")
    put("x.tmp", "1")
    put("node_modules/y.go", "1")
    put(".git/HEAD", "1")
    poll()
    put("a.go", "22")
    os.remove(f"{folder}/b/c.go")
    put("d.go", "1")
    poll()
    poll()  # nothing new
    put("b/c.go", "333")
    poll()
    got = sorted((r["poll"], r["path"], r["change"], r["bytes"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, "a.go", "created", 1), (1, "b/c.go", "created", 1), (2, "a.go", "changed", 2), (2, "b/c.go", "removed", None), (2, "d.go", "created", 1), (3, "b/c.go", "created", 3)]
    assert [n for n in os.listdir(f"{tmp_path}/log") if n.endswith(".changes")] in (["3.changes"], ["2.changes", "3.changes"], ["3.changes", "2.changes"])


def test_a_replayed_batch_is_the_same(tmp_path):
    options = {"path": f"{tmp_path}/watched", "log": f"{tmp_path}/log"}
    os.makedirs(options["path"])
    for k in range(3):
        with open(f"{options['path']}/f{k}", "w") as f:
            f.write("x" * k)
        assert polling.PollReader(options).latestOffset() == {"poll": k + 1}
    reader = polling.PollReader(options)
    rows = lambda: [r for p in reader.partitions({"poll": 1}, {"poll": 3}) for r in reader.read(p)]
    first = rows()
    assert [r[:3] for r in first] == [(2, "f1", "created"), (3, "f2", "created")]
    os.remove(f"{options['path']}/f2")
    assert rows() == first and reader.latestOffset() == {"poll": 4}
    reader.commit({"poll": 3})
    assert [r[:3] for p in reader.partitions({"poll": 3}, {"poll": 4}) for r in reader.read(p)] == [(4, "f2", "removed")]
