"""Runtime usage: period buckets, upserts, matching, coverage, dead code and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.scoring import period

CONFIDENCE = {"exact": 0.95, "strong": 0.85, "weak": 0.60, "unmatched": 0.0}


def by_period(calls: DataFrame, kind: str) -> DataFrame:
    """``function, period, calls, errors`` with the period's first day, so that periods of any kind compare as dates."""
    day = F.col("ts").cast("date")
    start = {"daily": day, "weekly": F.date_trunc("week", "ts").cast("date")}.get(kind, F.trunc(day, "month"))
    by = calls.groupBy("function", period(F.col("ts"), kind).alias("period"), start.alias("period_start"))
    return by.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("value") < 0.1).alias("errors"))


def upsert_add(state: DataFrame, batch: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """State after a batch whose counts are added to equal keys; keys may be null and then match each other."""
    joined = state.alias("s").join(batch.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts]).alias("b"), [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    return joined.select(*[F.coalesce(f"s.{k}", f"b.{k}").alias(k) for k in keys], *[(F.coalesce(f"s.{c}", F.lit(0)) + F.coalesce(f"b.{c}", F.lit(0))).alias(c) for c in counts])


def upsert_replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it lacks."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def upsert_patch(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``coalesce(new, old)`` column by column."""
    cols = [c for c in old.columns if c != key]
    return old.alias("o").join(new.alias("n"), key, "full").select(key, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in cols])


def quality_coverage(matched: DataFrame) -> DataFrame:
    """Attribute and match coverage, one row: attributes .5 file + .3 namespace + .2 line, overall .3 / .5 / .2."""
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    attr = 0.5 * rate(F.col("has_file")) + 0.3 * rate(F.col("has_namespace")) + 0.2 * rate(F.col("has_line"))
    effective = rate(F.col("quality").isin("exact", "strong"))
    one = matched.agg(F.round(attr, 6).alias("attributes"), F.round(effective, 6).alias("effective"), F.round(rate(F.col("quality") != "unmatched"), 6).alias("matched"))
    overall = F.round(0.3 * F.col("attributes") + 0.5 * F.col("effective") + 0.2 * F.col("matched"), 6)
    level = F.when(overall >= 0.8, "high").when(overall >= 0.6, "medium").when(overall >= 0.3, "low").otherwise("insufficient")
    return one.withColumn("overall", overall).withColumn("level", level)


def distinct_by_quality(matched: DataFrame) -> DataFrame:
    """Distinct symbols per match quality, in one pass."""
    return matched.agg(*[F.countDistinct(F.when(F.col("quality") == q, F.col("symbol_id"))).alias(q) for q in CONFIDENCE])


def tiered_match(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbol of each call by the first tier that finds one: exact (file, line, name), strong (file, name if unique there),
    weak (namespace, name if unique there; an ambiguous namespace stops), global (name if unique).

    ``calls``: call_id, name, file, namespace, line; ``symbols``: symbol_id, name, file, namespace, line. Every tier joins
    against its key's aggregate, one row a key, so no tier can multiply rows.
    """
    def tier(keys: list[str], name: str) -> DataFrame:
        return symbols.groupBy(*keys).agg(F.min("symbol_id").alias(f"{name}_id"), F.count(F.lit(1)).alias(f"{name}_n"))

    out = calls.join(tier(["file", "line", "name"], "exact"), ["file", "line", "name"], "left")
    out = out.join(tier(["file", "name"], "strong"), ["file", "name"], "left")
    out = out.join(tier(["namespace", "name"], "weak"), ["namespace", "name"], "left")
    out = out.join(tier(["name"], "any"), ["name"], "left")
    exact, strong = F.col("exact_id").isNotNull(), F.col("strong_n") == 1
    weak, stuck, single = F.col("weak_n") == 1, F.col("weak_n") > 1, F.col("any_n") == 1
    pick = lambda a, b, c, d, e: F.when(exact, a).when(strong, b).when(weak, c).when(stuck, e).when(single, d).otherwise(e)
    none = F.lit(None).cast("long")
    return out.select(
        "call_id",
        pick(F.col("exact_id"), F.col("strong_id"), F.col("weak_id"), F.col("any_id"), none).alias("symbol_id"),
        pick(F.lit("exact"), F.lit("strong"), F.lit("weak"), F.lit("weak"), F.lit("unmatched")).alias("quality"),
        pick(F.lit(0.95), F.lit(0.85), F.lit(0.6), F.lit(0.5), F.lit(0.0)).alias("confidence"),
    )


def same_name(a: Column, b: Column) -> Column:
    """Equal, or equal to the other's part after the last dot."""
    return (a == b) | (F.substring_index(a, ".", -1) == b) | (F.substring_index(b, ".", -1) == a)


def map_services(services: DataFrame, exact: dict[str, str], patterns: list[tuple[str, str]]) -> DataFrame:
    """``service, repo``: by name, else by the first pattern that matches, with its groups put in. The rules are configuration, so they are one expression."""
    named: Column | None = F.element_at(F.create_map(*[F.lit(x) for kv in exact.items() for x in kv]), F.col("service")) if exact else F.lit(None).cast("string")
    for regex, repo in patterns:
        named = F.coalesce(named, F.when(F.col("service").rlike(regex), F.regexp_replace("service", regex, repo)))
    return services.withColumn("repo", named)


def unused(symbols: DataFrame, usage: DataFrame, least_confidence: float, coverage: float) -> DataFrame:
    """Symbols that no call reached, with a confidence of ``0.9 * coverage`` less for weak matches; sorted by the caller."""
    sums = usage.groupBy("symbol_id").agg(F.sum("calls").alias("calls"))
    found = symbols.join(sums, "symbol_id", "left").where(F.coalesce("calls", F.lit(0)) == 0)
    conf = F.round(F.least(F.lit(0.9), F.when(F.col("exported"), 0.8).otherwise(0.9) * F.lit(coverage)), 6)
    return found.withColumn("confidence", conf).where(conf >= least_confidence).drop("calls")


def verdict(callers: Column, has_decision: Column, public: Column) -> tuple[Column, Column]:
    """Keep, investigate or remove, and how sure."""
    v = F.when(callers > 0, "keep").when(has_decision, "investigate").when(public, "investigate").otherwise("remove")
    return v, F.when(callers > 0, 0.9).when(has_decision, 0.75).when(public, 0.6).otherwise(0.7)


def half_trend(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Newer half against the older: up over 1.2, down under 0.8; an empty older half is up if anything came since."""
    down = Window.partitionBy(key).orderBy(F.desc(order))
    whole = Window.partitionBy(key)
    r = rows.withColumn("i", F.row_number().over(down)).withColumn("half", F.floor(F.count(F.lit(1)).over(whole) / 2))
    by = r.groupBy(key).agg(F.sum(F.when(F.col("i") <= F.col("half"), F.col(value)).otherwise(0)).alias("recent"), F.sum(F.when(F.col("i") > F.col("half"), F.col(value)).otherwise(0)).alias("older"), F.count(F.lit(1)).alias("n"))
    ratio = F.try_divide(F.col("recent").cast("double"), F.col("older").cast("double"))
    trend = F.when(F.col("n") < 2, "stable").when((F.col("older") == 0) & (F.col("recent") > 0), "increasing").when(F.col("older") == 0, "stable").when(ratio > 1.2, "increasing").when(ratio < 0.8, "decreasing").otherwise("stable")
    return by.select(key, "recent", "older", trend.alias("trend"))


def sampling(calls: DataFrame) -> DataFrame:
    """Services whose counts look sampled: over 100 rows of which over 80 % are round."""
    by = calls.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("k") % 10 == 0, 1.0).otherwise(0.0)).alias("round_share"))
    return by.select("service", "n", F.round("round_share", 6).alias("round_share"), ((F.col("n") > 100) & (F.col("round_share") > 0.8)).alias("sampled"))


def rollup_metrics(rows: DataFrame, key: str) -> DataFrame:
    """Per tool: runs, sums and ratios, 0 where there is nothing to divide by."""
    by = rows.groupBy(key).agg(F.count(F.lit(1)).alias("runs"), F.sum("k").alias("items"), F.sum(F.when(F.col("k") > 50, F.col("k") - 50).otherwise(0)).alias("dropped"), F.sum("value").alias("ms"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    return by.select(key, "runs", "items", "dropped", ratio(F.col("dropped"), F.col("items")).alias("truncation"), ratio(F.col("ms"), F.col("runs")).alias("mean_ms"))
