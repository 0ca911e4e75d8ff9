"""Interval joins between positions and definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.shared import cut

STRIDE = 64


def _in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with the number ``part`` of their range of ``doc`` and ``order``, written once: a document of very many rows spreads over as many ranges as it fills."""
    return cut(rows.repartitionByRange("doc", *order).withColumn("part", F.spark_partition_id()))


def close(defs: DataFrame, tail: int = 500) -> DataFrame:
    """End of each range: the line before the next start of its document, or ``tail`` lines on for the last.

    Definitions are sorted into ranges; the last one of a range takes the first start of the document's next range, of which
    there is one row a document and range.
    """
    r = _in_ranges(defs, "start", "id")
    firsts = r.groupBy("doc", "part").agg(F.min("start").alias("first"))
    follow = firsts.select("doc", "part", F.lead("first").over(Window.partitionBy("doc").orderBy("part")).alias("follow"))
    w = Window.partitionBy("part", "doc").orderBy("start", "id")
    out = r.withColumn("next", F.lead("start").over(w)).join(follow, ["doc", "part"], "left")
    return out.withColumn("end", F.coalesce(F.coalesce("next", "follow") - 1, F.col("start") + tail)).select(*defs.columns, "end")


def innermost(points: DataFrame, defs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """``pid, id`` of the smallest range that holds each point (ties: later start, then smaller id); points outside all are left out.

    Ranges are cut into ``stride``-line cells, so that the join is an equi-join on document and cell and no document
    meets all its points in one task. Of ranges with the same lines of a cell only the best can win there, so a cell has at
    most about ``stride ** 2 / 2`` of them, however many ranges there are; and each line is looked up once, however many
    points lie on it.
    """
    low, high = F.col("cell") * stride, (F.col("cell") + 1) * stride
    size = F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("late"), "id")
    cells = defs.select("doc", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / stride), F.floor(F.col("end") / stride))).alias("cell"), size.alias("best"))
    cells = cells.groupBy("doc", "cell", F.greatest("start", low).alias("start"), F.least("end", high).alias("end")).agg(F.min("best").alias("best"))
    lines = points.select("doc", "line", F.floor(F.col("line") / stride).alias("cell")).distinct()
    found = lines.join(cells, ["doc", "cell"]).where("line between start and end").groupBy("doc", "line").agg(F.min("best").alias("best"))
    return points.join(found, ["doc", "line"]).groupBy("pid").agg(F.min("best").alias("best")).select("pid", F.col("best.id").alias("id"))


def enclosing(points: DataFrame, defs: DataFrame) -> DataFrame:
    """``pid, id``: the last definition that starts at or before each point, as an as-of join.

    Definitions and points are sorted together into ranges. The last definition seen is carried forward inside a range, and
    from range to range by a table of one row a document and range, so one document of all rows is the work of many tasks.
    """
    mark = lambda kind, i, p: (F.lit(kind).alias("kind"), i.cast("long").alias("id"), p.cast("long").alias("pid"))
    both = defs.select("doc", F.col("start").cast("long").alias("at"), *mark(0, F.col("id"), F.lit(None)))
    both = both.unionByName(points.select("doc", F.col("line").cast("long").alias("at"), *mark(1, F.lit(None), F.col("pid"))))
    r = _in_ranges(both, "at", "kind", "id", "pid")
    lasts = r.groupBy("doc", "part").agg(F.max_by("id", F.when(F.col("kind") == 0, F.struct("at", "id"))).alias("last"))
    before = Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("doc", "part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    w = Window.partitionBy("part", "doc").orderBy("at", "kind", "id", "pid").rowsBetween(Window.unboundedPreceding, 0)
    out = r.withColumn("found", F.last("id", ignorenulls=True).over(w)).where("kind = 1").join(carried, ["doc", "part"], "left")
    return out.select("pid", F.coalesce("found", "carried").alias("id")).where("id is not null")
