"""Co-change coupling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.scoring import ladder

#: A commit's files are dealt out over slices of about so many, each of which meets all of the commit's files in its own task.
SLICE_FILES = 100


def co_changes(changes: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Ordered pairs of files that change together: ``path, other, together, changes, correlation``.

    ``correlation`` is the share of ``path``'s commits that touch ``other``. Repeated rows of a commit count once. All commits
    count, as in the reference, whatever their size. ``targets`` (column ``path``) restricts the first file of the pairs before they are made.
    """
    one = changes.select("commit_id", "path").distinct()
    sized = one.groupBy("commit_id").agg(F.count(F.lit(1)).alias("files"))
    kept = one.join(sized.select("commit_id", F.ceil(F.col("files") / SLICE_FILES).cast("int").alias("slices")), "commit_id")
    left = kept if targets is None else kept.join(targets, "path", "left_semi")
    base = left.groupBy("path").agg(F.count(F.lit(1)).alias("changes"))
    left = left.select("commit_id", "path", F.pmod(F.hash("path"), F.col("slices")).alias("slice"))
    right = kept.select("commit_id", F.col("path").alias("other"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    pairs = left.join(right, ["commit_id", "slice"]).where("path <> other")
    out = pairs.groupBy("path", "other").agg(F.count(F.lit(1)).alias("together")).join(base, "path")
    return out.withColumn("correlation", F.round(F.col("together") / F.col("changes"), 6))


def coupled(changes: DataFrame, least: float, together: int, targets: DataFrame | None = None) -> DataFrame:
    """Pairs at or above a correlation, with a level: high from 0.8, medium from 0.5."""
    pairs = co_changes(changes, targets).where((F.col("correlation") >= least) & (F.col("together") >= together))
    return pairs.withColumn("level", ladder(F.col("correlation"), [(0.8, "high"), (0.5, "medium")], "low"))
