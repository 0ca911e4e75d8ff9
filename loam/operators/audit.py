"""Risk audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.scoring import level


def audit(files: DataFrame) -> DataFrame:
    """Eight-factor score of ``file, complexity, tested, authors, months, sensitive, coupled, commits_90d``.

    Each factor is a saturated share of its weight: complexity 20, no tests 15, bus factor 15 or 7, staleness 10, security 15,
    coupling 5, churn 5; the error-rate factor is always 0.
    """
    part = lambda c, full, weight: F.least(F.col(c) / F.lit(float(full)), F.lit(1.0)) * weight
    scored = files.select(
        "file",
        part("complexity", 50, 20).alias("complexity"),
        F.when(F.col("tested"), 0.0).otherwise(15.0).alias("tests"),
        F.when(F.col("authors") <= 1, 15.0).when(F.col("authors") == 2, 7.0).otherwise(0.0).alias("bus_factor"),
        part("months", 12, 10).alias("staleness"),
        F.when(F.col("sensitive"), 15.0).otherwise(0.0).alias("security"),
        part("coupled", 10, 5).alias("coupling"),
        part("commits_90d", 20, 5).alias("churn"),
    )
    names = ["complexity", "tests", "bus_factor", "staleness", "security", "coupling", "churn"]
    scored = scored.withColumn("score", F.round(sum((F.col(n) for n in names), F.lit(0.0)), 6))
    top = F.greatest(*[F.struct(F.col(n).alias("v"), F.lit(n).alias("n")) for n in names])["n"]
    return scored.withColumn("level", level(F.col("score"))).withColumn("top_factor", top)


def audit_summary(audited: DataFrame) -> DataFrame:
    """Files per level."""
    return audited.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.round(F.avg("score"), 4).alias("mean_score"))


def quick_wins(audited: DataFrame, limit: int = 10) -> DataFrame:
    """Up to five complex files without tests by score, then files of one author, ``limit`` in all."""
    by = lambda df, kind, n: df.orderBy(F.desc("score"), "file").limit(n).withColumn("action", F.lit(kind))
    first = by(audited.where("tests > 0 and complexity >= 10"), "add tests", 5)
    second = by(audited.where("bus_factor = 15 and not (tests > 0 and complexity >= 10)"), "share knowledge", limit - 5)
    return first.unionByName(second).select("file", "score", "action")


def pr_risk(changes: DataFrame, hot: DataFrame) -> DataFrame:
    """Risk of each change set: files 0.3 or 0.15, churn 0.3 or 0.15, hot files up to 0.3, modules 0.2."""
    by = changes.join(hot.select("path", F.lit(1).alias("hot")), "path", "left").groupBy("commit_id")
    by = by.agg(F.countDistinct("path").alias("files"), F.sum(F.col("additions") + F.col("deletions")).alias("churn"), F.countDistinct(F.when(F.col("hot") == 1, F.col("path"))).alias("hot"), F.countDistinct("module").alias("modules"))
    score = F.when(F.col("files") > 20, 0.3).when(F.col("files") > 5, 0.15).otherwise(0.0) + F.when(F.col("churn") > 500, 0.3).when(F.col("churn") > 100, 0.15).otherwise(0.0)
    score = score + F.least(F.col("hot") * 0.1, F.lit(0.3)) + F.when(F.col("modules") > 3, 0.2).otherwise(0.0)
    by = by.withColumn("score", F.round(score, 6))
    return by.withColumn("risk", F.when(F.col("score") > 0.6, "high").when(F.col("score") > 0.3, "medium").otherwise("low"))
