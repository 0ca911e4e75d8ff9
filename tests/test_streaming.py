"""Streams give what their batch twins give."""

from pyspark.sql import functions as F

from loam.sources import relations as R
from loam.streaming import usage

SF = "/root/testdata/sf0.001"


def _run(df, name, mode="complete"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def _rows(df):
    return sorted(map(str, df.collect()))


def test_period_counts(spark):
    got = _run(usage.period_counts(usage.read_events(spark, SF)), "periods")
    assert _rows(got) == _rows(usage.period_counts(R.calls(spark, SF)))


def test_sliding(spark):
    got = _run(usage.sliding(usage.read_events(spark, SF), "24 hours", "12 hours"), "slides")
    assert _rows(got.select("w", "events")) == _rows(usage.sliding(R.calls(spark, SF), "24 hours", "12 hours").select("w", "events"))


def test_debounce(spark):
    got = _run(usage.debounced(usage.read_events(spark, SF), "service", "30 minutes"), "bursts")
    assert _rows(got) == _rows(usage.debounced(R.calls(spark, SF), "service", "30 minutes"))


def test_ingest_counts_once_and_quarantines(spark, tmp_path):
    symbols = spark.createDataFrame([(1, "click"), (2, "view")], "symbol_id long, name string")
    for turn in range(2):  # the second run finds nothing new
        usage.ingest(usage.read_events(spark, SF), symbols, f"{tmp_path}/t{turn and 0}", f"{tmp_path}/q", f"{tmp_path}/c").awaitTermination(120)
    got = usage.usage_state(spark, f"{tmp_path}/t0").groupBy("symbol_id").agg(F.sum("calls").alias("n")).collect()
    want = R.calls(spark, SF).join(symbols, F.col("function") == F.col("name")).groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert spark.read.parquet(f"{tmp_path}/q").count() == R.calls(spark, SF).where("function not in ('click', 'view')").count()
