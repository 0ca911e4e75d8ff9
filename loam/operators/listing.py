"""Lookups, listings, ranks and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.modules import ancestors


def point(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def listing(df: DataFrame, conditions: list[Column | None], order: list, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows that meet all conditions that are given, in a total order."""
    for c in conditions:
        df = df if c is None else df.where(c)
    df = df.orderBy(*order).offset(offset) if offset else df.orderBy(*order)
    return df.limit(limit) if limit else df


def first_condition(df: DataFrame, conditions: list[Column | None]) -> DataFrame:
    """Rows that meet the first condition that is given; all rows without any."""
    found = next((c for c in conditions if c is not None), None)
    return df if found is None else df.where(found)


def ranked(column: Column, order: list[str]) -> Column:
    """Place of a value in a list, its length for any other."""
    return F.coalesce(F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])[column], F.lit(len(order)))


def first_n(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= n)


def nearest_ancestor(paths: DataFrame, records: DataFrame, newest: int) -> DataFrame:
    """``path, record``: records of the path itself or else of its nearest ancestor that has any, the ``newest`` by id.

    ``records``: module, record.
    """
    up = paths.select("path", F.explode(ancestors(F.col("path"))).alias("module"))
    have = up.join(records.select("module").distinct(), "module")
    best = have.groupBy("path").agg(F.max_by("module", F.length("module")).alias("module"))
    return first_n(best.join(records, "module"), "path", [F.desc("record")], newest).select("path", "module", "record")


def max_or_mean(df: DataFrame, key: str, score: str, reason: str, high: float) -> DataFrame:
    """The largest score of a key if it is high enough, else the mean, and the reason of the largest (ties by name)."""
    by = df.groupBy(key).agg(F.max(score).alias("__m"), F.avg(score).alias("__a"), F.max_by(reason, F.struct(score, reason)).alias("reason"))
    return by.select(key, F.round(F.when(F.col("__m") >= high, F.col("__m")).otherwise(F.col("__a")), 6).alias("score"), "reason")


def work_queue(queue: DataFrame, files: int, cost: str, budget: float) -> DataFrame:
    """What fits a budget: items by age and depth, up to ``files`` of them, while their running cost stays within ``budget``."""
    first = queue.orderBy("enqueued", "depth", "id").limit(files)
    running = F.sum(cost).over(Window.orderBy("enqueued", "depth", "id").rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("spent", running).where(F.col("spent") <= budget)


def seed_expansion(seeds: DataFrame, members: DataFrame, cap: int) -> DataFrame:
    """Seeds and, up to ``cap`` in all by id, the members of seed types (``owner, id``)."""
    more = members.join(seeds.select(F.col("id").alias("owner")), "owner", "left_semi").select("id")
    both = seeds.select("id").withColumn("p", F.lit(0)).unionByName(more.withColumn("p", F.lit(1)))
    return both.groupBy("id").agg(F.min("p").alias("p")).orderBy("p", "id").limit(cap)


def validate(df: DataFrame, required: list[str], key: list[str]) -> DataFrame:
    """Rows, rows with a missing required value, and repeated keys, one row."""
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    whole = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(missing).alias("incomplete"), F.countDistinct(F.struct(*key)).alias("__keys"))
    return whole.select("rows", "incomplete", (F.col("rows") - F.col("__keys")).alias("repeated"))
