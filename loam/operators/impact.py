"""Impact of a change: classification, risk and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(is_test: Column, ref_kind: Column) -> tuple[Column, Column]:
    """Impact kind and confidence of a reference; tests come first."""
    known = {"call": ("direct-caller", 0.95), "implements": ("implementer", 0.95), "type": ("type-dependency", 0.9), "read": ("reader", 0.85), "write": ("writer", 0.85)}
    kind, conf = F.when(is_test, "test-dependency"), F.when(is_test, 0.8)
    for k, (name, c) in known.items():
        kind, conf = kind.when(ref_kind == k, name), conf.when(ref_kind == k, c)
    return kind.otherwise("unknown"), conf.otherwise(0.5)


def risk_score(visibility: Column, callers: Column, modules: Column, kinds: Column) -> Column:
    """``.3`` visibility + ``.35`` callers + ``.25`` module spread + ``.1`` impact kind, each from 0 to 1."""
    seen = F.when(visibility == "public", 0.9).when(visibility == "internal", 0.5).otherwise(0.2)
    many = F.least(F.log10(callers + 1) / F.log10(F.lit(21.0)), F.lit(1.0))
    spread = F.when(modules <= 1, 0.0).when(modules == 2, 0.2).otherwise(F.least(F.log10(modules.cast("double")), F.lit(1.0)))
    return F.round(0.3 * seen + 0.35 * many + 0.25 * spread + 0.1 * kinds, 6)


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def with_usage(score: Column, calls: Column, services: Column, rising: Column) -> Column:
    """Risk blended with observed usage .2, diversity .15 and trend .1, at least the static score less its share and at most 0.03 above the largest part."""
    parts = [(score, 0.55), (F.least(F.log10(calls + 1) / 4, F.lit(1.0)), 0.2), (F.least(services / 10, F.lit(1.0)), 0.15), (F.when(rising, 1.0).otherwise(0.0), 0.1)]
    mean = sum((v * w for v, w in parts), F.lit(0.0))
    return F.round(F.least(mean, F.greatest(*[v for v, _ in parts]) + 0.03), 6)


def mean_confidence(hundredths: Column, n: Column) -> Column:
    """Mean of ``n`` confidences from their sum in hundredths, to six places, halves up: in whole numbers, so that no order of adding matters."""
    millionths = F.call_function("div", hundredths * 20_000 + n, 2 * n)
    return millionths / F.lit(1e6)


def impact_report(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per target: callers, modules, tests, risk. ``refs``: target, source, kind, is_test; ``symbols``: symbol_id, module, visibility.

    Kinds and test flags are decided before aggregation, and the callers' modules come from a join.
    """
    kind, conf = classify(F.col("is_test"), F.col("kind"))
    item = refs.withColumn("impact", kind).withColumn("confidence", conf).join(symbols.select(F.col("symbol_id").alias("source"), F.col("module").alias("source_module")), "source", "left")
    by = item.groupBy("target").agg(
        F.countDistinct(F.when(~F.col("is_test"), F.col("source"))).alias("callers"),
        F.countDistinct(F.when(~F.col("is_test"), F.col("source_module"))).alias("modules"),
        F.count_if("is_test").alias("tests"),
        F.max(F.when(F.col("impact") == "direct-caller", 0.9).when(F.col("impact") == "type-dependency", 0.7).otherwise(0.4)).alias("kind_risk"),
        mean_confidence(F.sum(F.round(F.col("confidence") * 100).cast("long")), F.count(F.lit(1))).alias("confidence"),
    )
    out = by.join(symbols.select(F.col("symbol_id").alias("target"), "visibility"), "target")
    score = risk_score(F.col("visibility"), F.col("callers"), F.col("modules"), F.col("kind_risk"))
    return out.withColumn("score", score).withColumn("level", risk_level(F.col("score"))).drop("kind_risk")


def module_rollup(report: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per module: targets and their worst level."""
    rank = F.when(F.col("level") == "high", 2).when(F.col("level") == "medium", 1).otherwise(0)
    by = report.join(symbols.select(F.col("symbol_id").alias("target"), "module"), "target").groupBy("module").agg(F.count(F.lit(1)).alias("targets"), F.max(rank).alias("r"))
    return by.select("module", "targets", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("r") + 1).alias("worst"))


def visibility_ladder(modifier: Column, refs: Column, name: Column) -> tuple[Column, Column]:
    """Visibility by modifier (0.95), by references from outside (0.9) or inside only (0.7), by naming, else unknown."""
    seen = F.when(modifier.isNotNull(), modifier).when(refs > 1, "public").when(refs == 1, "internal").when(name.startswith("_"), "private").when(name.rlike("^[A-Z]"), "public").otherwise("internal")
    conf = F.when(modifier.isNotNull(), 0.95).when(refs > 1, 0.9).when(refs == 1, 0.7).when(name.startswith("_"), 0.7).when(name.rlike("^[A-Z]"), 0.6).otherwise(0.5)
    return seen, conf
