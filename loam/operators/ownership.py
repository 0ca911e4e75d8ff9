"""Ownership: time-decayed blame, rules, drift and contributors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions.scoring import owner_scope, owner_type, pattern_specificity
from loam.operators.modules import ancestors

HALF_LIFE_DAYS = 90.0
LEAST_SHARE = 0.05
#: Names and addresses of automatons, and the address that stands for no one.
BOTS = (r"\[bot\]$", "^dependabot", "^renovate", "^github-actions")
NO_ADDRESS = "noreply@github.com"


def author_key(name: Column, email: Column) -> Column:
    """One key for an author: the address in lower case, or the name where there is none."""
    email = F.coalesce(email, F.lit(""))
    return F.lower(F.when((email != "") & (email != NO_ADDRESS), email).otherwise(name))


def is_bot(name: Column, email: Column, patterns: tuple[str, ...] = BOTS) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | F.coalesce(name, F.lit("")).rlike(p) | F.coalesce(email, F.lit("")).rlike(p)
    return found


def people(blame: DataFrame, patterns: tuple[str, ...] = BOTS) -> DataFrame:
    """Blame lines of persons, ``file, author, ts``, from ``file, name, email, ts``: automatons' lines are left out, one person's names are one."""
    kept = blame.where(~is_bot(F.col("name"), F.col("email"), patterns))
    return kept.select("file", author_key(F.col("name"), F.col("email")).alias("author"), "ts")


def decayed_shares(blame: DataFrame, as_of: str, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """``file, author, weight, lines, share`` with weight halved every ``half_life`` days; partial sums shuffle, lines don't."""
    age = F.greatest(F.datediff(F.lit(as_of).cast("date"), F.col("ts").cast("date")), F.lit(0))
    by = blame.groupBy("file", "author").agg(F.sum(F.pow(F.lit(0.5), age / F.lit(half_life))).alias("weight"), F.count(F.lit(1)).alias("lines"))
    total = F.sum("weight").over(Window.partitionBy("file"))
    return by.withColumn("share", F.coalesce(F.try_divide("weight", total), F.lit(0.0)))


def owners(blame: DataFrame, as_of: str) -> DataFrame:
    """Authors with at least 5 % of a file's decayed weight, with their scope."""
    kept = decayed_shares(blame, as_of).where(F.col("share") >= LEAST_SHARE)
    return kept.select("file", "author", "lines", F.round("share", 6).alias("share"), owner_scope(F.col("share")).alias("scope"))


def bus_factor(blame: DataFrame) -> DataFrame:
    """Per file: authors, share of the busiest one, and whether one person holds it alone."""
    by = blame.groupBy("file", "author").agg(F.count(F.lit(1)).alias("lines")).groupBy("file")
    by = by.agg(F.count(F.lit(1)).alias("authors"), F.max("lines").alias("top"), F.sum("lines").alias("lines"))
    return by.select("file", "authors", F.round(F.col("top") / F.col("lines"), 6).alias("top_share"), (F.col("authors") <= 1).alias("alone"))


def drift(declared: DataFrame, shares: DataFrame, threshold: float) -> DataFrame:
    """Share of a file's weight that is not its declared owners'; ``declared`` has ``file, author``.

    Files without contributors have no drift and are left out; shares are fractions from 0 to 1.
    """
    marked = shares.join(declared.withColumn("own", F.lit(1)), ["file", "author"], "left")
    by = marked.groupBy("file").agg(F.round(F.sum(F.when(F.col("own").isNull(), F.col("share")).otherwise(0.0)), 6).alias("drift"), F.max_by("author", F.struct("share", -F.col("author"))).alias("top_author"))
    said = F.when(F.col("drift") >= 0.8, "replaced").when(F.col("drift") >= 0.5, "shifted").otherwise("partial")
    return by.where(F.col("drift") >= threshold).withColumn("finding", said)


def module_drift(labelled: DataFrame) -> DataFrame:
    """Per module (``module, drift``): files, mean drift."""
    return labelled.groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.round(F.avg("drift"), 6).alias("mean_drift"))


def contributors(blame: DataFrame) -> DataFrame:
    """Per author: lines, first and last day, and the file touched last (ties: largest)."""
    return blame.groupBy("author").agg(
        F.count(F.lit(1)).alias("lines"),
        F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"),
        F.max_by("file", F.struct("ts", "file")).alias("last_file"),
    )


def origin(commits: DataFrame) -> DataFrame:
    """First commit of each author (ties: smallest id), and how many followed."""
    by = commits.groupBy("author").agg(F.min_by("commit_id", F.struct("ts", "commit_id")).alias("first_commit"), F.count(F.lit(1)).alias("commits"))
    return by.withColumn("followed", F.col("commits") - 1)


def glob_regex(pattern: str) -> str:
    """An ownership pattern as an anchored regular expression over paths without a leading slash.

    A leading slash anchors at the root, a trailing one means a directory, ``*`` stays inside a segment and ``**`` crosses.
    """
    rooted = pattern.startswith("/")
    body = pattern.strip("/")
    parts = re.split(r"(\*\*/?|\*|\?)", body)
    table = {"**": ".*", "**/": "(?:.*/)?", "*": "[^/]*", "?": "[^/]"}
    regex = "".join(table.get(p, re.escape(p)) for p in parts)
    tail = "/.*" if pattern.endswith("/") else "(?:/.*)?"
    return ("^" if rooted or "/" in body else "^(?:.*/)?") + regex + tail + "$"


def parse_rules(text: str) -> list[tuple[int, str, list[str], bool]]:
    """``(line, pattern, owners, negated)`` of a rules file; comments and blank lines are skipped."""
    out = []
    for i, line in enumerate(text.splitlines(), 1):
        body = line.split("#", 1)[0].split()
        if body:
            out.append((i, body[0].removeprefix("!"), body[1:], body[0].startswith("!")))
    return out


def last_match(paths: DataFrame, rules: list[tuple[int, str, list[str], bool]], column: str = "path") -> DataFrame:
    """Owners of each path by the last rule that matches; a negated rule clears them.

    Rules are a reviewed file of bounded size, so they become one expression, evaluated from the last rule up.
    """
    owners: Column = F.lit(None).cast("array<string>")
    line: Column = F.lit(None).cast("int")
    for number, pattern, who, negated in rules:
        hit = F.col(column).rlike(glob_regex(pattern))
        owners = F.when(hit, F.array(*[F.lit(w) for w in who]) if who and not negated else F.lit(None).cast("array<string>")).otherwise(owners)
        line = F.when(hit, F.lit(number)).otherwise(line)
    return paths.withColumn("owners", owners).withColumn("rule", line)


def most_specific(paths: DataFrame, patterns: list[tuple[str, str, float]]) -> DataFrame:
    """``path, pattern, owner`` by the longest matching pattern, then confidence, then name.

    Patterns from the root without wildcards are a table that is joined to the path's ancestors; the others, a reviewed list,
    are one expression over the path. So no path meets every pattern in a join.
    """
    spark: SparkSession = paths.sparkSession
    plain = [p for p in patterns if p[0].startswith("/") and not set(p[0]) & set("*?")]
    table = spark.createDataFrame([(p.strip("/"), p.endswith("/"), p, o, c, len(p)) for p, o, c in plain], "root string, below boolean, pattern string, owner string, confidence double, length int")
    up = paths.select("path", F.explode(ancestors(F.col("path"))).alias("root")).join(table, "root").where(~F.col("below") | (F.col("path") != F.col("root")))
    row = lambda p, o, c: F.struct(F.lit(p).alias("pattern"), F.lit(o).alias("owner"), F.lit(c).alias("confidence"), F.lit(len(p)).alias("length"))
    tried = [F.when(F.col("path").rlike(glob_regex(p)), row(p, o, float(c))) for p, o, c in patterns if (p, o, c) not in plain]
    hits = up.select("path", F.struct("pattern", "owner", "confidence", "length").alias("hit"))
    if tried:
        hits = hits.unionByName(paths.select("path", F.explode(F.filter(F.array(*tried), lambda x: x.isNotNull())).alias("hit")))
    best = hits.groupBy("path").agg(F.max_by("hit", F.struct("hit.length", "hit.confidence", "hit.pattern")).alias("best"))
    return best.select("path", "best.pattern", "best.owner", pattern_specificity(F.col("best.pattern")).alias("specificity"), owner_type(F.col("best.owner")).alias("owner_type"))


def review_coverage(files: DataFrame, owners_: DataFrame) -> DataFrame:
    """Owners by how many of the changed ``files`` (column ``file``) they own: ``author, files, coverage``."""
    total = files.agg(F.count(F.lit(1)).alias("total"))
    by = owners_.join(files, "file", "left_semi").groupBy("author").agg(F.countDistinct("file").alias("files"))
    return by.crossJoin(F.broadcast(total)).select("author", "files", F.round(F.col("files") / F.col("total"), 6).alias("coverage"))  # one row


def staleness_months(blame: DataFrame, as_of: str) -> DataFrame:
    """Calendar months since the last change of each file."""
    last = F.max("ts")
    return blame.groupBy("file").agg((F.year(F.lit(as_of).cast("date")) * 12 + F.month(F.lit(as_of).cast("date")) - F.year(last) * 12 - F.month(last)).cast("long").alias("months"))
