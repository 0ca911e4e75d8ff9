"""Modules, imports, languages and architecture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: File endings and their languages.
LANGUAGES = {"go": "go", "py": "python", "js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript", "java": "java", "kt": "kotlin", "rs": "rust", "rb": "ruby", "cs": "csharp", "cpp": "cpp", "c": "c", "h": "c", "php": "php", "swift": "swift", "dart": "dart", "scala": "scala"}

#: So many roots are broadcast.
BROADCAST_ROOTS = 200_000


def language(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ending], F.lit("unknown"))


def first_segments(path: Column, n: int) -> Column:
    """The first ``n`` segments of a path; the whole path if it has no more."""
    return F.substring_index(path, "/", n)


def ancestors(path: Column) -> Column:
    """The path's directories from the root down, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def longest_prefix(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``path, module``: the module whose root is the longest prefix of whole segments.

    Each path is cut into its ancestors, which makes the prefix test an equi-join. Roots are broadcast while they are few, as
    all paths have the first of them in common.
    """
    roots = F.broadcast(roots) if roots.count() <= BROADCAST_ROOTS else roots
    cut = files.select("path", F.explode(ancestors(F.col("path"))).alias("root"))
    return cut.join(roots, "root").groupBy("path").agg(F.max_by("module", F.length("root")).alias("module"))


def classify_import(source: Column, module: Column, stdlib: list[str], workspace: list[str]) -> Column:
    """Local file, standard library, workspace, local module, external or unknown, in this order."""
    first = F.substring_index(module, "/", 1)
    return F.when(module.startswith("."), "local-file").when(first.isin(stdlib), "stdlib").when(first.isin(workspace), "workspace").when(first == F.substring_index(source, "/", 1), "local-module").when(first.contains("."), "external").otherwise("unknown")


def module_edges(imports: DataFrame) -> DataFrame:
    """Edges between modules with the number of imports; self-edges and external ones are left out."""
    return imports.where((F.col("kind") != "external") & (F.col("source") != F.col("target"))).groupBy("source", "target").agg(F.count(F.lit(1)).alias("strength"))


def module_map(symbols: DataFrame, top: int = 3) -> DataFrame:
    """Per module: symbols, kinds, summed score and the names of the ``top`` symbols by score (ties by id)."""
    w = Window.partitionBy("module").orderBy(F.desc("score"), "symbol_id")
    r = symbols.withColumn("i", F.row_number().over(w))
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= top, F.struct("i", "name")))), lambda x: x["name"])
    return r.groupBy("module").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("kind").alias("kinds"), F.round(F.sum("score"), 4).alias("score"), F.array_join(names, "|").alias("top_names"))


def prefer_first(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first source that has any: each later one counts only where all before are empty."""
    union = parts[0].withColumn("priority", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        union = union.unionByName(p.withColumn("priority", F.lit(i)))
    least = union.agg(F.min("priority").alias("__least"))
    return union.join(F.broadcast(least), F.col("priority") == F.col("__least")).drop("__least").dropDuplicates([key])


def language_quality(files: DataFrame) -> DataFrame:
    """Per language: files, references per symbol and a level."""
    by = files.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("symbols").alias("symbols"), F.sum("refs").alias("refs"))
    ratio = F.round(F.coalesce(F.try_divide(F.col("refs").cast("double"), F.col("symbols").cast("double")), F.lit(0.0)), 6)
    return by.withColumn("ratio", ratio).withColumn("level", F.when(F.col("ratio") >= 3, "full").when(F.col("ratio") >= 1, "partial").otherwise("basic"))


def importance(usage: Column, complexity: Column) -> Column:
    """Export importance from usage and complexity."""
    p = F.when(usage >= 1000, 3).when(usage >= 100, 2).when(usage >= 10, 1).otherwise(0) + F.when(complexity >= 20, 2).when(complexity >= 10, 1).otherwise(0)
    return F.when(p >= 4, "high").when(p >= 2, "medium").otherwise("low")
