"""Scoring expressions shared by operators. Each maps columns to a column and stays inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(value: Column, steps: list[tuple[float, object]], default: object) -> Column:
    """The first step whose bound ``value`` reaches, from the top down."""
    return reduce(lambda acc, s: acc.when(value >= s[0], F.lit(s[1])), steps[1:], F.when(value >= steps[0][0], F.lit(steps[0][1]))).otherwise(F.lit(default))


def recency_class(age: Column) -> Column:
    """``recent`` up to 7 days, ``moderate`` up to 30, else ``stale``; unknown ages are stale."""
    return F.when(age <= 7, "recent").when(age <= 30, "moderate").otherwise("stale")


def recency_points(age: Column) -> Column:
    """10, 8, 6, 4, 2 or 1 points by age in days; none if unknown."""
    return F.when(age.isNull(), 0).when(age <= 1, 10).when(age <= 7, 8).when(age <= 30, 6).when(age <= 90, 4).when(age <= 180, 2).otherwise(1)


def saturating(value: Column, half: float) -> Column:
    """``v / (v + half)``: 0 at 0, one half at ``half``."""
    return value / (value + F.lit(half))


def level(score: Column) -> Column:
    """Risk level of a score of 0 to 100."""
    return ladder(score, [(80, "critical"), (60, "high"), (40, "medium")], "low")


def churn_score(changes: Column, authors: Column, mean: Column) -> Column:
    return 0.5 * saturating(changes, 10.0) + 0.2 * saturating(authors, 3.0) + 0.3 * saturating(mean, 30.0)


def instability(incoming: Column, outgoing: Column) -> Column:
    """Outgoing share of all couplings, one half where there is none."""
    return F.coalesce(F.try_divide(outgoing.cast("double"), (incoming + outgoing).cast("double")), F.lit(0.5))


def staleness(behind: Column, age_days: Column) -> Column:
    """Worst of what commits behind and age say."""
    return F.when((age_days > 90) | (behind > 500), "critical").when((age_days > 30) | (behind > 200), "stale").when((age_days > 7) | (behind > 50), "aging").otherwise("fresh")


def owner_scope(share: Column) -> Column:
    return ladder(share, [(0.5, "maintainer"), (0.2, "reviewer")], "contributor")


def owner_type(owner: Column) -> Column:
    """Team (``@org/team``), user (``@name``), email or unknown."""
    return F.when(owner.rlike("^@[^/]+/.+"), "team").when(owner.startswith("@"), "user").when(owner.contains("@"), "email").otherwise("unknown")


def pattern_specificity(pattern: Column) -> Column:
    """0.1 for ``*``, 0.5 with ``**``, 0.7 with another star, else 1 plus a hundredth per character, 2 at most."""
    return F.when(pattern == "*", 0.1).when(pattern.contains("**"), 0.5).when(pattern.contains("*"), 0.7).otherwise(F.least(1 + F.length(pattern) / 100, F.lit(2.0)))


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(r"_test\.|\.test\.|/test/|/tests/|_test$|\.spec\.")


def visibility(name: Column) -> tuple[Column, Column]:
    """Visibility and confidence from naming alone."""
    seen = F.when(name.startswith("_"), "private").when(name.rlike("^[A-Z]"), "public").otherwise("internal")
    return seen, F.when(name.startswith("_"), 0.7).when(name.rlike("^[A-Z]"), 0.6).otherwise(0.5)


def period(ts: Column, kind: str) -> Column:
    """Period key: ``daily`` yyyy-MM-dd, ``weekly`` ISO yyyy-Www, else monthly yyyy-MM. Null timestamps have none."""
    if kind == "daily":
        return F.date_format(ts, "yyyy-MM-dd")
    if kind == "weekly":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return F.date_format(ts, "yyyy-MM")


def row_digest(*cols: Column) -> Column:
    """SHA-256 over ``length:value`` of each column; lengths in bytes, nulls as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.sha2(F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]), 256)


def privacy_hash(name: Column) -> Column:
    """First three characters and the low 16 bits of the 31-polynomial of the (ASCII) name."""
    code = F.aggregate(F.transform(F.split(name, ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 65536)
    return F.concat(F.substring(name, 1, 3), F.lit("-"), F.lpad(F.lower(F.hex(code)), 4, "0"))
