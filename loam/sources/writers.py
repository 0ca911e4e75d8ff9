"""Sinks: tables, time series, change artifacts and text exports."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import files
from loam.functions.shared import shared_dir


def overwrite(df: DataFrame, path: str, *partition: str) -> None:
    """Full refresh."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def append_series(df: DataFrame, path: str, day: str = "snapshot_date") -> None:
    """Append snapshots under their day."""
    df.write.mode("append").partitionBy(day).parquet(path)


def compact(spark: SparkSession, path: str, out: str, files: int) -> None:
    """Rewrite a table into ``files`` files."""
    spark.read.parquet(path).repartition(files).write.mode("overwrite").parquet(out)


def postings_table(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """The inverted index, its terms dealt to ``buckets`` folders, so that a query reads those of its terms only."""
    p = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    p.repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup_postings(spark: SparkSession, path: str, terms: list[str], buckets: int = 64) -> DataFrame:
    """Postings of some terms: partition pruning first, then the terms."""
    wanted = spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int").alias("b")).collect()  # a row a term
    return spark.read.parquet(path).where(F.col("bucket").isin([r["b"] for r in wanted]) & F.col("term").isin(terms))


#: Tables that this process has laid out, with their seconds, for reports.
BUILDS: list[tuple[str, float]] = []


def laid_out(df: DataFrame, name: str, write: Callable[[str], None]) -> str:
    """Folder of what ``write`` makes of the table ``df``, made once for a state of the table's files.

    It lies in the shared folder under a name made of the files' names, lengths and times, so a rewritten table is laid out
    anew, and any application finds what is there; it gets that name when it is whole. A table that is not read from files is
    laid out every time.
    """
    spark, mark = df.sparkSession, files.snapshot_mark(df)
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{name} {mark}").hex if mark else uuid.uuid4().hex
    at = f"{shared_dir(spark)}/loam-{name}-{own}"
    if not files.names(spark, at):
        began, part = time.perf_counter(), f"{at}-{uuid.uuid4().hex}"
        write(part)
        if not files.move(spark, part, at):  # another application has written the same meanwhile
            files.delete(spark, part)
        BUILDS.append((name, time.perf_counter() - began))
    return at


def search_index(docs: DataFrame, key: str, text: str) -> tuple[str, DataFrame]:
    """Folder of the inverted index of a table's texts, and its one row of ``n, mean`` (documents, mean length). Queries read the buckets of their terms, and no text."""
    from loam.operators import search

    def write(at: str) -> None:
        postings_table(search.postings(docs, key, text), f"{at}/postings")
        search.corpus_size(docs, text).write.parquet(f"{at}/size")

    at = laid_out(docs, f"search-{key}-{text}", write)
    return f"{at}/postings", docs.sparkSession.read.parquet(f"{at}/size")


def clustered(df: DataFrame, rows: DataFrame, name: str, *by: str) -> DataFrame:
    """``rows``, made from the table ``df``, sorted into ranges of ``by``: a filter on its first column skips files and row groups by their minima and maxima.

    A very common value spreads over several files where ``by`` goes on with a finer column.
    """
    at = laid_out(df, name, lambda at: rows.repartitionByRange(*by).sortWithinPartitions(*by).write.option("compression", "zstd").parquet(f"{at}/rows"))
    return df.sparkSession.read.parquet(f"{at}/rows")


def delta_artifact(diff: DataFrame, path: str) -> None:
    """Differences as JSON lines, sorted within files."""
    diff.sortWithinPartitions(*diff.columns).write.mode("overwrite").json(path)


def prometheus(df: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Text exposition lines of a counter."""
    parts = [x for i, c in enumerate(labels) for x in (F.lit(("," if i else "") + c + '="'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"'))]
    return df.select(F.concat(F.lit(name + "{"), *parts, F.lit("} "), F.col(value).cast("string")).alias("line"))


def llm_export(symbols: DataFrame, budget: int) -> DataFrame:
    """``module, text``: modules as text, their symbols by score, ``budget`` symbols of each."""
    from pyspark.sql import Window

    w = Window.partitionBy("module").orderBy(F.desc("score"), "symbol_id")
    r = symbols.withColumn("i", F.row_number().over(w)).where(F.col("i") <= budget)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "name", "kind"))), lambda x: F.concat(F.lit("- "), x["name"], F.lit(" ("), x["kind"], F.lit(")"))), "\n")
    return r.groupBy("module").agg(body.alias("body")).select("module", F.concat(F.lit("## "), "module", F.lit("\n"), "body").alias("text"))
