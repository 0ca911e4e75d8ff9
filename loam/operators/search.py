"""Text and symbol search: postings, BM25, tiers, lexical scores and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.series import minmax

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case ASCII words."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))


def postings(docs: DataFrame, key: str, text: str, terms: list[str] | None = None) -> DataFrame:
    """``term, key, tf, length``: the inverted index as a table, or its part for ``terms``, whose other words never leave their row."""
    t = docs.select(key, tokens(F.col(text)).alias("ts")).withColumn("length", F.size("ts").cast("long"))
    if terms is not None:
        t = t.withColumn("ts", F.filter("ts", lambda w: w.isin(terms)))
    return t.select(key, "length", F.explode("ts").alias("term")).groupBy("term", key, "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25(index: DataFrame, sizes: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """``key, score`` of documents with at least one term. Only the query's terms leave the index scan.

    ``sizes`` holds one row, ``n, mean``: documents in all and their mean length.
    """
    hits = index.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    r = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(sizes))  # a row a term; one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return r.groupBy(key).agg(F.sum(part).alias("score"))


def corpus_size(docs: DataFrame, text: str) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens(F.col(text)))).alias("mean"))


def tiers(symbols: DataFrame, query: str, limit: int) -> DataFrame:
    """Exact, prefix and substring matches in that order, each symbol in its best tier; deduplicated before the limit."""
    low, q = F.lower("name"), query.lower()
    tier = F.when(low == q, 1).when(low.startswith(q), 2).when(low.contains(q), 3)
    out = symbols.withColumn("tier", tier).where(F.col("tier").isNotNull())
    return out.withColumn("rank", F.when(F.col("tier") == 1, 1.0).when(F.col("tier") == 2, 0.8).otherwise(0.5)).orderBy("tier", "name", "symbol_id").limit(limit)


def lexical(name: Column, query: str, visibility: Column, kind: Column) -> Column:
    """Points for the match, the visibility and the kind."""
    low, q = F.lower(name), query.lower()
    match = F.when(low == q, 100).when(low.startswith(q), 50).when(low.contains(q), 25).otherwise(10)
    seen = F.when(visibility == "public", 30).when(visibility == "internal", 20).when(visibility == "private", 10).otherwise(5)
    sort = F.when(kind == "class", 25).when(kind == "interface", 20).when(kind == "function", 15).when(kind == "method", 10).otherwise(5)
    return match + seen + sort


def fuse(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of min-max normalised features."""
    for c in weights:
        rows = minmax(rows, c, f"__{c}")
    total = sum((F.col(f"__{c}") * w for c, w in weights.items()), F.lit(0.0))
    return rows.withColumn("fused", F.round(total, 6)).drop(*[f"__{c}" for c in weights])


def rerank(rows: DataFrame, order: list, graph: str) -> DataFrame:
    """``0.6 / position + 0.4 * graph``: positions of a result list, which the caller has limited."""
    w = Window.orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w)).withColumn("final", F.round(0.6 / F.col("position") + 0.4 * F.col(graph), 6))


def evaluate(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Recall at ``k`` in percent and mean reciprocal rank over cases: ``results`` case, item, rank; ``expected`` case, item."""
    hit = expected.join(results, ["case", "item"], "left").groupBy("case").agg(F.min("rank").alias("rank"))
    passed = F.when(F.col("rank") <= k, 1.0).otherwise(0.0)
    return hit.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(passed) * 100, 4).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
