"""Documentation: mentions, suffix resolution, coverage and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the notation: a qualified name between backticks, endings that mark a file rather than a symbol, code fences
#: that open and close with the same marks, and comments that name symbols for tools.
MENTION = r"`([A-Za-z_][A-Za-z0-9_]*(?:(?:::|->|[.#/])[A-Za-z_][A-Za-z0-9_]*)+)`"
FILE_ENDING = r"\.(?:go|js|ts|tsx|jsx|py|rs|java|kt|rb|c|cpp|h|hpp|cs|swift|md|json|yaml|yml|toml|xml|html|css|scss|sql|sh|bash|zsh|scip|lock|sum|mod)$"
FENCE = r"(?ms)^[ \t]*(```|~~~)\w*[ \t]*$.*?^[ \t]*\1[ \t]*$"
QUALIFIED = r"([A-Za-z_][A-Za-z0-9_]*(?:(?:\.|::)[A-Za-z_][A-Za-z0-9_]*)+)"
SYMBOL = r"<!--\s*\w+:symbol\s+([^\s>]+)\s*-->"
KNOWN = r"<!--\s*\w+:known_symbols\s+([^>]+?)\s*-->"
#: Names found in fenced code count for less.
FENCE_FACTOR = 0.7


def _line_breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", ""))


def mentions(docs: DataFrame, key: str, text: str, pattern: str = MENTION) -> DataFrame:
    """``key, line, mention, method, known`` of what a document names; lines count from 1.

    ``backtick``: names between backticks on any line, but for files; ``directive``: names in symbol comments; ``fence``:
    qualified names in closed fenced blocks, once a block, at its first line. ``known`` tells whether a comment of the
    document lists the name, or its end, as known. Every line is read once.
    """
    listed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(KNOWN), F.lit(1)), lambda x: F.split(F.lower(x), r"\s*,\s*")))
    src = docs.select(key, F.col(text).alias("__text"), F.filter(listed, lambda x: x != "").alias("__known"))
    lines = src.select(key, "__known", F.posexplode(F.split("__text", "\n")).alias("i", "body"))
    ticks = F.filter(F.regexp_extract_all("body", F.lit(pattern), F.lit(1)), lambda x: ~x.rlike(FILE_ENDING))
    named = lambda found, method: F.transform(found, lambda x: F.struct(x.alias("mention"), F.lit(method).alias("method")))
    both = F.concat(named(ticks, "backtick"), named(F.regexp_extract_all("body", F.lit(SYMBOL), F.lit(1)), "directive"))
    plain = lines.where(F.col("body").contains("`") | F.col("body").contains("<!--")).select(key, "__known", (F.col("i") + 1).alias("line"), F.explode(both).alias("m"))
    # Blocks and the text between them take turns, so the breaks before a block are those of all that stands before it.
    fenced = src.where(F.col("__text").rlike(FENCE)).select(key, "__known", F.regexp_extract_all("__text", F.lit(FENCE), F.lit(0)).alias("blocks"), F.split("__text", FENCE).alias("between"))
    breaks = lambda c: F.transform(c, lambda x: _line_breaks(x))
    fenced = fenced.select(key, "__known", F.posexplode("blocks").alias("at", "block"), breaks(F.col("blocks")).alias("b"), breaks(F.col("between")).alias("o"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    start = total(F.slice("o", 1, F.col("at") + 1)) + total(F.slice("b", 1, F.col("at"))) + 1
    names = F.array_distinct(F.regexp_extract_all("block", F.lit(QUALIFIED), F.lit(1)))
    inside = fenced.select(key, "__known", start.alias("line"), F.explode(named(names, "fence")).alias("m"))
    out = plain.unionByName(inside).select(key, "line", "m.mention", "m.method", "__known")
    end = F.lower(normalise(F.col("mention")))
    return out.withColumn("known", F.exists("__known", lambda k: (end == k) | F.endswith(end, F.concat(F.lit("."), k)))).drop("__known")


def normalise(mention: Column) -> Column:
    """Separators ``::``, ``->``, ``#`` and ``/`` become dots; a trailing call is dropped."""
    return F.regexp_replace(F.regexp_replace(mention, r"\(\)$", ""), r"::|->|[#/]", ".")


def suffixes(name: Column, least: int = 2) -> Column:
    """All endings of a dotted name that have ``least`` segments or more, the whole name included."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    return F.when(n >= least, F.transform(F.sequence(F.lit(1), n - least + 1), lambda i: F.array_join(F.slice(parts, i, n), "."))).otherwise(F.array().cast("array<string>"))


def suffix_index(symbols: DataFrame, least: int = 2) -> DataFrame:
    """``suffix, symbol_id, name``."""
    return symbols.select(F.explode(suffixes(F.col("name"), least)).alias("suffix"), "symbol_id", "name")


def resolve(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """``mid, symbol_id, status, confidence`` of each mention.

    Names of one segment are ineligible unless ``known``; then exact 1.0, unique ending 0.95 (0.85 if of one segment),
    ambiguous, or missing. Where ``found`` has a ``method``, names from fenced code count ``FENCE_FACTOR`` of that.
    """
    exact = symbols.groupBy(F.col("name").alias("m")).agg(F.min("symbol_id").alias("exact_id"))
    ends = suffix_index(symbols, 1).groupBy(F.col("suffix").alias("s")).agg(F.min("symbol_id").alias("end_id"), F.countDistinct("symbol_id").alias("ends"))
    r = found.join(exact, F.col("mention") == F.col("m"), "left").join(ends, F.col("mention") == F.col("s"), "left")
    single = ~F.col("mention").contains(".")
    barred = single & ~F.col("known") if "known" in found.columns else single
    whole, one = F.col("exact_id").isNotNull(), F.col("ends") == 1
    status = F.when(barred, "ineligible").when(whole, "exact").when(one, "suffix").when(F.col("ends") > 1, "ambiguous").otherwise("missing")
    conf = F.when(barred, 0.0).when(whole, 1.0).when(one & single, 0.85).when(one, 0.95).otherwise(0.0)
    if "method" in found.columns:
        conf = F.round(conf * F.when(F.col("method") == "fence", FENCE_FACTOR).otherwise(1.0), 6)
    sid = F.when(barred, None).when(whole, F.col("exact_id")).when(one, F.col("end_id"))
    return r.select("mid", sid.alias("symbol_id"), status.alias("status"), conf.alias("confidence"))


def coverage(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Documented symbols, all symbols and their share, one row."""
    marked = symbols.select("symbol_id").join(refs.select("symbol_id").distinct().withColumn("has", F.lit(1)), "symbol_id", "left")
    one = marked.agg(F.count("has").alias("documented"), F.count(F.lit(1)).alias("symbols"))
    return one.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("documented").cast("double"), F.col("symbols").cast("double")), F.lit(0.0)), 6))


def undocumented(symbols: DataFrame, refs: DataFrame, limit: int) -> DataFrame:
    """Undocumented symbols by score."""
    return symbols.join(refs.select("symbol_id").distinct(), "symbol_id", "left_anti").orderBy(F.desc("score"), "symbol_id").limit(limit)


def stale(refs: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """References to symbols that no longer exist, with the alias's new id where there is one."""
    return refs.join(symbols.select("symbol_id"), "symbol_id", "left_anti").join(aliases, F.col("symbol_id") == F.col("old"), "left").select("ref_id", "symbol_id", F.col("new").alias("renamed_to"), F.when(F.col("new").isNotNull(), "renamed").otherwise("missing").alias("reason"))
