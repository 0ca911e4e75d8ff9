"""Snapshots, differences and change application."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.scoring import row_digest


def hashed(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Key and row hash."""
    return df.select(*key, row_digest(*[F.col(c) for c in columns]).alias("hash"))


def table_hash(rows: DataFrame) -> DataFrame:
    """One hash of all row hashes, in any order: SHA-256 over the row count and the sums of the hashes' four 60-bit parts.

    Sums add up before the shuffle, so a table of any size moves one row a task; repeated rows count.
    """
    limb = lambda i: F.sum(F.conv(F.substring("hash", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = rows.agg(F.count(F.lit(1)).cast("string").alias("n"), *[limb(i).alias(f"s{i}") for i in range(4)])
    return sums.select(F.sha2(F.concat_ws("|", "n", *[F.coalesce(f"s{i}", F.lit("0")) for i in range(4)]), 256).alias("snapshot"))


def diff(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``key, op`` with op added, deleted or modified, from two hashed tables."""
    j = base.alias("b").join(new.alias("n"), [F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full")
    op = F.when(F.col("b.hash").isNull(), "added").when(F.col("n.hash").isNull(), "deleted").when(F.col("b.hash") != F.col("n.hash"), "modified")
    return j.select(*[F.coalesce(f"b.{k}", f"n.{k}").alias(k) for k in key], op.alias("op")).where("op is not null")


def apply_changes(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` after a change feed of its own columns and ``op`` (A, M, D, R) and ``old_key``: rows of touched keys go, rows
    that are not deletions come. A rename removes its old key, or its own where none is given."""
    gone = changes.select(F.explode(F.array(F.col(key), F.coalesce("old_key", key))).alias(key)).distinct()
    came = changes.where("op <> 'D'").select(*base.columns)
    return base.join(gone, key, "left_anti").unionByName(came)


def last_wins(feeds: list[DataFrame], key: str) -> DataFrame:
    """Union of change feeds; of a key, the row of the last feed, then of the highest ``seq``."""
    union = feeds[0].withColumn("__f", F.lit(0))
    for i, f in enumerate(feeds[1:], 1):
        union = union.unionByName(f.withColumn("__f", F.lit(i)))
    cols = [c for c in union.columns if c != key]
    return union.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("__f", "seq")).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols if c != "__f"])


def change_code(status: Column) -> Column:
    """Status letters (``R100``, ``T`` ...) as A, M, D or R; copies add, type changes modify."""
    first = F.substring(status, 1, 1)
    return F.when(first == "C", "A").when(first == "T", "M").otherwise(first)


def page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """A keyset page: rows after a key, one more than asked so that the caller sees whether there are more."""
    kept = df if after is None else df.where(F.col(key) > F.lit(after))
    return kept.orderBy(key).limit(size + 1)


def truncation(df: DataFrame, size: int) -> DataFrame:
    """Rows before a limit, returned and dropped, one row."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("original"), F.least(n, F.lit(size)).alias("returned"), F.greatest(n - size, F.lit(0)).alias("dropped"))


def hits_and_misses(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each id and whether the table has it."""
    return ids.join(table.select(key).distinct().withColumn("__h", F.lit(True)), key, "left").select(key, F.coalesce("__h", F.lit(False)).alias("found"))


def _plain(x: Column, single: bool) -> Column:
    """A floating number to six places as the shortest decimal text: digits alone from 1e-4 up to 1e16, ``1e-05`` and ``1e+16`` beyond; -0.0 keeps its sign."""
    places = F.round(x, 6) if single else F.when(F.abs(x) < 1e300, F.round(x * 1e6) / 1e6).otherwise(x)
    powers = [F.format_string(f"%.{n}e", places) for n in ((7, 8) if single else (14, 15, 16))]
    power = F.coalesce(*[F.when(t.try_cast("float" if single else "double") == places, t) for t in powers], powers[-1])
    digits = F.regexp_replace(F.regexp_replace(power.try_cast("decimal(38,6)").cast("string"), "0+$", ""), r"\.$", ".0")
    size = F.abs(places)
    text = F.when((size >= 1e-4) & (size < 1e16), digits).otherwise(F.regexp_replace(power, r"\.?0+e", "e"))
    text = F.when(places == 0, F.when(x.cast("string").startswith("-"), F.lit("-0.0")).otherwise(F.lit("0.0"))).otherwise(text)
    odd = F.isnan(x) | (size == float("inf"))
    return F.when(odd, F.concat(F.lit('"'), x.cast("string"), F.lit('"'))).when(x.isNotNull(), text)


def canonical_json(df: DataFrame, *columns: str) -> Column:
    """Compact JSON of ``df``'s columns, sorted by name, without nulls, floating numbers to six places.

    Spark writes doubles from 1e7 up and below 1e-3 with an exponent, so numbers are put into text here.
    """
    kinds = dict(df.dtypes)

    def field(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            return F.concat(F.lit(json.dumps(c, ensure_ascii=False) + ":"), _plain(F.col(c), kinds[c] == "float"))
        whole = F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "true"})
        return F.when(F.col(c).isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))

    return F.concat(F.lit("{"), F.concat_ws(",", *[field(c) for c in sorted(columns)]), F.lit("}"))
