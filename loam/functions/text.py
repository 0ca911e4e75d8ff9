"""String, path and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

#: Words that say how a thing is built, not what it is about.
TECHNICAL = ["Handler", "Service", "Manager", "Factory", "Impl", "Controller", "Provider", "Helper", "Util", "Utils", "Test"]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def camel_words(name: Column) -> Column:
    """Words of a camel-case name: a cut before every capital but the first letter."""
    return F.split(name, "(?<=.)(?=[A-Z])")


def concept(name: Column) -> Column:
    """The last word that is not technical and longer than two letters, with a capital; null if there is none."""
    words = F.filter(camel_words(name), lambda w: ~w.isin(TECHNICAL) & (F.length(w) > 2))
    return F.initcap(F.try_element_at(words, F.lit(-1)))


def normalise_path(path: Column) -> Column:
    """Forward slashes, no ``./``, no doubled or trailing slash; null if it climbs out with ``..``."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/(\./)+|//+", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), r"(?<=.)/$", "")
    return F.when(p.rlike(r"(^|/)\.\.(/|$)"), F.lit(None)).otherwise(p)


def short_hash(value: Column, digits: int = 8) -> Column:
    return F.substring(F.sha2(value, 256), 1, digits)


def issue_keys(message: Column) -> Column:
    """Distinct issue numbers, pull requests and tickets of a message, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(message, F.lit(r"(#\d+|[A-Z]{2,}-\d+)"), F.lit(1))))


def human(n: Column) -> Column:
    """Counts with k or M."""
    return F.when(n >= 1_000_000, F.concat(F.round(n / 1_000_000, 1).cast("string"), F.lit("M"))).when(n >= 1000, F.concat(F.round(n / 1000, 1).cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def occurrences_of(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word in a text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def path_score(kind: Column, length: Column, confidence: Column) -> Column:
    """Base by kind (100 down to 20) less five a step, times confidence, at least 0."""
    base = F.when(kind == "api", 100).when(kind == "cli", 80).when(kind == "job", 60).when(kind == "event", 40).otherwise(20)
    return F.round(F.greatest(F.lit(0.0), (base - 5 * (length - 1)) * confidence), 6)


def warnings(months: Column, authors: Column, strong: Column, temporary: Column) -> Column:
    """Warnings that hold, in a fixed order."""
    return F.array_compact(F.array(F.when(temporary & (months > 3), "temporary"), F.when(authors <= 1, "bus-factor"), F.when(strong >= 3, "coupled"), F.when(months >= 12, "stale")))


def since_days(as_of: str, period: str) -> Column:
    """First day of a relative period: 7d, 30d, 90d (also for anything else), or null for all."""
    days = {"7d": 7, "30d": 30, "90d": 90, "all": None}.get(period, 90)
    return F.lit(None).cast("date") if days is None else F.date_sub(F.lit(as_of).cast("date"), days)
