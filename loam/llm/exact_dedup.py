"""Exact deduplication that one very common text cannot slow down.

Three combining steps, each grouping by the full normalised text beside its digest, so that no step trusts a digest:
within a task (Spark's map-side aggregation), within a salted digest group, and over the salts' winners. Of equal texts
the largest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

SALTS = 16


def _normalised(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    norm = lower_ascii(F.coalesce(docs[text_col], F.lit("")))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), norm.alias("norm"))
    return rows.select("doc_id", "norm", F.sha2("norm", 256).alias("text_sha256"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Rows that repeat both id and text cannot
    be told apart and get the same values. A null id never wins over another; if a text has only null ids, ``keep_id`` is
    null and its rows are kept. Other columns of ``docs`` play no part, whatever their names. An empty table gives none.

    Rows find their group again by digest and salt, which no group of copies can make uneven: a salted group holds a
    ``1 / salts`` share at most, and there are at most ``salts`` rows for a digest. Should two different texts ever share a
    SHA-256, the query stops with an error instead of mixing their rows.
    """
    rows = _normalised(docs, id_col, text_col, salts)
    salted = rows.groupBy("text_sha256", "salt", "norm").agg(F.max("doc_id").alias("best"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("text_sha256", "norm").agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    by_digest = whole.groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.bit_or("salts").alias("salts"), F.count(F.lit(1)).alias("texts"))
    checked = by_digest.select(
        "text_sha256",
        "keep_id",
        F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a digest")).cast("long")).otherwise(F.col("group_size")).alias("group_size"),
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.getbit("salts", s) == 1)).alias("salt"),
    )
    keys = rows.select("doc_id", "text_sha256", "salt")
    out = keys.join(checked, ["text_sha256", "salt"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """``doc_id, text_sha256`` that stay, one row per text: the first two steps of :func:`exact_dedup` alone."""
    rows = _normalised(docs, id_col, text_col, salts)
    salted = rows.groupBy("text_sha256", "salt", "norm").agg(F.max("doc_id").alias("best"))
    return salted.groupBy("text_sha256", "norm").agg(F.max("best").alias("doc_id")).select("doc_id", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per text, with all its columns: of equal texts (null counts as empty) the row with the largest id.

    An id that stands for several texts stays with each text it wins. Where rows repeat both id and text, the first by a
    hash of the row stays; such rows are grouped with a combining step, so that their number does not matter. An empty
    table gives none; the names of other columns do not matter.
    """
    keep = winners(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    norm = lower_ascii(F.coalesce(docs[text_col], F.lit("")))
    marked = docs.withColumns({"__of": docs[id_col].cast("long"), "__digest": F.sha2(norm, 256)})
    stay = marked.join(keep, F.col("__of").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__sha")), "left_semi")
    again = marked.select("__of", "__digest").groupBy("__of", "__digest").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("__of").alias("__id"), F.col("__digest").alias("__sha"))
    same = F.col("__of").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__sha"))
    once = stay.join(again, same, "left_anti").select(*docs.columns)
    row = F.struct(*[F.col(c) for c in docs.columns])
    first = stay.join(again, same, "left_semi").groupBy("__of", "__digest").agg(F.min_by(row, F.xxhash64(row)).alias("__row"))
    return once.unionByName(first.select(*[F.col("__row")[c].alias(c) for c in docs.columns]))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
