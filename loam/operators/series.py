"""Time series of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trend(points: DataFrame, horizon_days: int = 30) -> DataFrame:
    """Per target: least-squares slope per day, direction, and the last score projected, at least 0.

    One point, or points of a single day, have slope 0.
    """
    first = F.min("date").over(Window.partitionBy("target"))
    x = points.withColumn("x", F.datediff("date", first).cast("double"))
    by = x.groupBy("target").agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.regr_slope("score", "x"), F.lit(0.0)).alias("slope"), F.max_by("score", "date").alias("last"))
    direction = F.when(F.col("points") < 2, "stable").when(F.col("slope") > 0.01, "increasing").when(F.col("slope") < -0.01, "decreasing").otherwise("stable")
    return by.select("target", "points", F.round("slope", 4).alias("slope"), direction.alias("direction"), F.round(F.greatest(F.lit(0.0), F.col("last") + F.col("slope") * horizon_days), 4).alias("projection"))


def latest(points: DataFrame, n: int = 1) -> DataFrame:
    """The last ``n`` points of each target; for one, a maximum that combines before the shuffle."""
    if n == 1:
        rest = [c for c in points.columns if c != "target"]
        return points.groupBy("target").agg(F.max_by(F.struct(*rest), "date").alias("__r")).select("target", *[F.col(f"__r.{c}").alias(c) for c in rest])
    w = Window.partitionBy("target").orderBy(F.desc("date"))
    return points.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def top_per_date(points: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest scores of each date; ties by target."""
    w = Window.partitionBy("date").orderBy(F.desc("score"), "target")
    return points.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def retain(points: DataFrame, newest: int, since: str) -> DataFrame:
    """What retention keeps: the newest ``newest`` of each target and all since a date."""
    w = Window.partitionBy("target").orderBy(F.desc("date"))
    return points.withColumn("nth", F.row_number().over(w)).where((F.col("nth") <= newest) | (F.col("date") >= F.lit(since).cast("date"))).drop("nth")


def minmax(df: DataFrame, column: str, out: str) -> DataFrame:
    """Min-max normalisation over all rows, one half where all are equal: the two bounds are one broadcast row, not a window over one partition."""
    bounds = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    scaled = F.when(F.col("__hi") == F.col("__lo"), F.lit(0.5)).otherwise((F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, scaled).drop("__lo", "__hi")


def share(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each row's share of its key's total, 0 where that is 0."""
    return df.withColumn("share", F.round(F.coalesce(F.try_divide(F.col(value).cast("double"), F.sum(value).over(Window.partitionBy(key)).cast("double")), F.lit(0.0)), 6))
