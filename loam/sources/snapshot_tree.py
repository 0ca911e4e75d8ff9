"""Snapshots with a tree of hashes, so that two of them are compared where they differ and nowhere else.

A row belongs to the leaf that a hash of its key names. A leaf's hash covers its rows' hashes in any order, an inner node's
those of its ``FAN`` children, up to the root. The tree is a small table beside the rows: ``FAN ** LEVELS`` leaves at most,
whatever the number of rows. Rows lie in folders of a leaf's first digit, sorted by leaf, so a few leaves are a few row groups.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loam.functions import files
from loam.functions.scoring import row_digest

FAN, LEVELS = 16, 3


def _leaf(key: list[str], levels: int):
    return F.pmod(F.xxhash64(*key), F.lit(FAN**levels)).cast("int")


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    """One hash per group of ``by`` over its members' ``hash`` and ``n``, in any order; partial sums are shuffled, not rows."""
    limbs = [F.sum(F.conv(F.substring("hash", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), *[x.alias(f"s{i}") for i, x in enumerate(limbs)]).select(
        *by, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("hash")
    )


def write(df: DataFrame, key: list[str], path: str, levels: int = LEVELS) -> None:
    """Keep ``df`` as a snapshot: rows under ``path/rows``, the tree under ``path/tree`` (``level, node, n, hash``).

    A key may stand for several rows, which count each; null keys are keys. Columns are covered by name and value.
    """
    cols = sorted(df.columns)
    rows = df.withColumns({"leaf": _leaf(key, levels), "hash": row_digest(*[F.col(c) for c in cols])})
    rows = rows.withColumn("top", F.floor(F.col("leaf") / FAN ** (levels - 1)).cast("int"))
    rows.repartition("top", F.col("leaf") % FAN).sortWithinPartitions("top", "leaf", *key).write.partitionBy("top").option("compression", "zstd").parquet(f"{path}/rows")
    spark = df.sparkSession
    files.create_text(spark, f"{path}/schema", rows.schema.json())  # a snapshot may have no row, so no file
    level = _sums(_rows(spark, path).select(F.col("leaf").alias("node"), "hash", F.lit(1).cast("long").alias("n")), "node")
    tree = level.withColumn("level", F.lit(levels))
    for k in range(levels - 1, -1, -1):
        level = _sums(level.select(F.floor(F.col("node") / FAN).cast("int").alias("node"), "n", "hash"), "node")
        tree = tree.unionByName(level.withColumn("level", F.lit(k)))
    tree.coalesce(1).sortWithinPartitions("level", "node").write.parquet(f"{path}/tree")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(StructType.fromJson(json.loads(files.read_text(spark, f"{path}/schema")))).parquet(f"{path}/rows")


def root(spark: SparkSession, path: str) -> str:
    """The hash of a whole snapshot; '' if it has no row."""
    r = spark.read.parquet(f"{path}/tree").where("level = 0").select("hash").first()
    return r["hash"] if r else ""


def differing_leaves(spark: SparkSession, base: str, new: str, levels: int = LEVELS) -> list[int]:
    """Leaves whose hashes differ, by descent from the root into differing nodes only."""
    trees = [spark.read.parquet(f"{p}/tree") for p in (base, new)]
    nodes = [0]
    for k in range(levels + 1):
        below = [t.where((F.col("level") == k) & F.col("node").between(nodes[0], nodes[-1]) & F.col("node").isin(nodes)).select("node", "hash") for t in trees]
        both = below[0].join(below[1].withColumnRenamed("hash", "other"), "node", "full")
        found = sorted(r["node"] for r in both.where(~F.col("hash").eqNullSafe(F.col("other"))).select("node").collect())  # FAN ** LEVELS at most
        if not found or k == levels:
            return found
        nodes = [n * FAN + i for n in found for i in range(FAN)]
    return []


def rows_of(spark: SparkSession, path: str, leaves: list[int], levels: int = LEVELS) -> DataFrame:
    """Rows of some leaves: their folders, and in them the row groups whose leaves' minima and maxima fit."""
    tops = sorted({n // FAN ** (levels - 1) for n in leaves})
    return _rows(spark, path).where(F.col("top").isin(tops) & F.col("leaf").isin(leaves)).drop("top")


def compare(spark: SparkSession, base: str, new: str, key: list[str], levels: int = LEVELS) -> DataFrame:
    """``key, op``: added, deleted or modified keys of ``new`` against ``base``; only differing leaves are read.

    Where a key stands for several rows, it is modified if its rows differ as a set with repeats.
    """
    leaves = differing_leaves(spark, base, new, levels) or [-1]
    sides = []
    for path, name in ((base, "old"), (new, "now")):
        r = rows_of(spark, path, leaves, levels)
        sides.append(_sums(r.select(*key, "hash", F.lit(1).cast("long").alias("n")), *key).select(*[F.col(k).alias(f"{name}_{k}") for k in key], F.col("hash").alias(name)))
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"old_{k}").eqNullSafe(F.col(f"now_{k}"))
    op = F.when(F.col("old").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("old") != F.col("now"), "modified")
    both = sides[0].join(sides[1], same, "full")
    return both.select(*[F.when(F.col("old").isNull(), F.col(f"now_{k}")).otherwise(F.col(f"old_{k}")).alias(k) for k in key], op.alias("op")).where("op is not null")
