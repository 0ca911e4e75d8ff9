"""Change history: hotspots, churn, recency and concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.scoring import recency_class, recency_points


def days_since(ts, as_of: str):
    """Whole days from ``ts`` to ``as_of``."""
    return F.datediff(F.lit(as_of).cast("date"), ts.cast("date")).cast("long")


def _by_file(changes: DataFrame) -> DataFrame:
    """``path, changes, authors, last_ts, lines, rows``: by file and commit, then author, then file, since a commit has one author.

    Each step combines before its shuffle, so two distinct counts cost no copy of the rows.
    """
    one = changes.groupBy("path", "commit_id").agg(F.min("author").alias("author"), F.max("ts").alias("ts"), F.sum(F.col("additions") + F.col("deletions")).alias("lines"), F.count(F.lit(1)).alias("rows"))
    who = one.groupBy("path", "author").agg(F.count(F.lit(1)).alias("changes"), F.max("ts").alias("ts"), F.sum("lines").alias("lines"), F.sum("rows").alias("rows"))
    return who.groupBy("path").agg(F.sum("changes").alias("changes"), F.count("author").alias("authors"), F.max("ts").alias("last_ts"), F.sum("lines").alias("lines"), F.sum("rows").alias("rows"))


def file_churn(changes: DataFrame) -> DataFrame:
    """Per file: changes, distinct authors, last change, mean lines changed, and ``sqrt(n) * ln(authors + 1) * ln(mean + 1)``; ties in the order are left to the caller."""
    by = _by_file(changes).withColumn("mean_lines", F.col("lines") / F.col("rows"))
    score = F.sqrt(F.col("changes").cast("double")) * F.log(F.col("authors") + F.lit(1.0)) * F.log(F.col("mean_lines") + 1)
    return by.select("path", "changes", "authors", "last_ts", F.round("mean_lines", 6).alias("mean_lines"), F.round(score, 6).alias("score"))


def hotspots(changes: DataFrame, since: str, as_of: str, limit: int) -> DataFrame:
    """The top ``limit`` files by churn score since a date, with recency class and risk; ties by path."""
    top = file_churn(changes.where(F.col("ts") >= F.lit(since).cast("timestamp")))
    age = days_since(F.col("last_ts"), as_of)
    risk = F.when(F.col("changes") > 10, "high").when(F.col("changes") > 5, "medium").otherwise("low")
    out = top.select("path", "changes", "authors", "mean_lines", "score", recency_class(age).alias("recency"), risk.alias("risk"))
    return out.orderBy(F.desc("score"), "path").limit(limit)


def recently_relevant(changes: DataFrame, since: str, as_of: str, limit: int) -> DataFrame:
    """Files by ``10 * recency + changes + authors / 2``; ties by path."""
    by = _by_file(changes.where(F.col("ts") >= F.lit(since).cast("timestamp")))
    age = days_since(F.col("last_ts"), as_of)
    score = recency_points(age) * 10.0 + F.col("changes") + F.col("authors") * 0.5
    return by.select("path", "changes", "authors", age.alias("age_days"), F.round(score, 6).alias("score")).orderBy(F.desc("score"), "path").limit(limit)


def key_concepts(symbols: DataFrame, least: int, limit: int) -> DataFrame:
    """Concepts (last word of a name) by ``symbols * modules``, with up to three symbols and five modules of each."""
    words = F.split("name", "[ _]")
    concept = F.initcap(F.element_at(words, -1))
    by = symbols.withColumn("concept", concept).where(F.length("concept") > 2).groupBy("concept")
    by = by.agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("module").alias("modules"), F.array_sort(F.collect_set("module")).alias("all_modules"))
    out = by.where(F.col("symbols") >= least).withColumn("score", F.col("symbols") * F.col("modules"))
    out = out.select("concept", "symbols", "modules", "score", F.array_join(F.slice("all_modules", 1, 5), ",").alias("top_modules"))
    return out.orderBy(F.desc("score"), "concept").limit(limit)


def history_totals(changes: DataFrame, since: str) -> DataFrame:
    """Commits, authors and files since a date, in one row."""
    return changes.where(F.col("ts") >= F.lit(since).cast("timestamp")).agg(F.countDistinct("commit_id").alias("commits"), F.countDistinct("author").alias("authors"), F.countDistinct("path").alias("files"))


def latest_commits(commits: DataFrame, since: str, limit: int) -> DataFrame:
    """Newest commits since a date; ties by id."""
    return commits.where(F.col("ts") >= F.lit(since).cast("timestamp")).orderBy(F.desc("ts"), F.desc("commit_id")).limit(limit)
