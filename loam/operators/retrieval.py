"""Search through an index's postings: phrases by positions, prefixes by ranges of terms, substrings by grams, and the tiers of them.

No function reads the texts, but for :func:`substring`, which reads those of its candidates to verify them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.shared import cut
from loam.functions.text import ASCII_LOWER, ASCII_UPPER, lower_ascii
from loam.operators.graph import push
from loam.operators.search import K1, B
from loam.sources.search_store import GRAM, Snapshot, gram_rows

#: Up to so many ids of the rarest term, or of candidates, are handed to every task.
FEW_IDS = 10_000
_LAST = chr(0x10FFFF)


def _lower(text: str) -> str:
    return text.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))


def query_tokens(query: str) -> list[str]:
    """As the index cuts texts."""
    return re.findall("[a-z0-9_]+", query.lower())


def _starts(column: str, prefix: str):
    return (F.col(column) >= prefix) & (F.col(column) <= prefix + _LAST)


def _weight(snapshot: Snapshot):
    return F.get(F.array(*[F.lit(float(w)) for w in snapshot.fields.values()]), F.col("field"))


def _none(snapshot: Snapshot) -> DataFrame:
    return snapshot.spark.createDataFrame([], "id long, score double")


def _scored(hits: DataFrame, snapshot: Snapshot, units: int) -> DataFrame:
    """``id, score`` of rows with every unit of a query, from ``id, unit, f, length``: BM25 over weighted frequencies."""
    df = hits.groupBy("unit").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(snapshot.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / snapshot.mean))
    out = hits.join(F.broadcast(df), "unit")  # a row a unit
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("units"), F.sum(part).alias("score")).where(F.col("units") == units).select("id", "score")


def _of_rarest(found: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of ids that the rarest term has too, where its list is short: a common term's postings then stay where they are read."""
    if len(terms) < 2:
        return found
    counts = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a term
    rarest = min(terms, key=lambda t: counts.get(t, 0))
    if counts.get(rarest, 0) > FEW_IDS:
        return found
    return found.join(F.broadcast(found.where(F.col("term") == rarest).select("id").distinct()), "id", "left_semi")


def phrase(snapshot: Snapshot, query: str) -> DataFrame:
    """``id, score`` of rows where the query's tokens stand side by side in one field.

    A phrase counts by its places: each token's positions, shifted by its place in the phrase, are intersected. Fields count
    with their weights. A query without tokens finds nothing.
    """
    terms = query_tokens(query)
    table = snapshot.table("postings")
    if not terms or table is None:
        return _none(snapshot)
    found = _of_rarest(table.where(F.col("term").isin(sorted(set(terms)))), sorted(set(terms)))
    places = {t: [i for i, x in enumerate(terms) if x == t] for t in set(terms)}
    at = F.create_map(*[x for t, p in places.items() for x in (F.lit(t), F.array(*[F.lit(i) for i in p]))])
    shifted = snapshot.live(found).select("id", "field", "length", "positions", F.explode(F.element_at(at, F.col("term"))).alias("i"))
    shifted = shifted.select("id", "field", "length", F.transform("positions", lambda p: p - F.col("i")).alias("starts"))
    both = shifted.groupBy("id", "field", "length").agg(F.collect_list("starts").alias("all")).where(F.size("all") == len(terms))
    starts = F.aggregate(F.slice("all", 2, len(terms)), F.get("all", 0), lambda a, x: F.array_intersect(a, x))
    hits = both.select("id", "length", (F.size(starts) * _weight(snapshot)).alias("f")).where("f > 0")
    hits = hits.groupBy("id", "length").agg(F.sum("f").alias("f")).withColumn("unit", F.lit(0))
    return _scored(hits, snapshot, 1)


def prefix(snapshot: Snapshot, query: str) -> DataFrame:
    """``id, score`` of rows that have all tokens of the query, the last one as the beginning of a token."""
    terms = query_tokens(query)
    table = snapshot.table("postings")
    if not terms or table is None:
        return _none(snapshot)
    whole, last = sorted(set(terms[:-1])), terms[-1]
    begins = _starts("term", last)
    rows = snapshot.live(table.where(begins | F.col("term").isin(whole)) if whole else table.where(begins))
    unit = F.array(F.when(begins, F.lit(len(whole))), *[F.when(F.col("term") == t, F.lit(i)) for i, t in enumerate(whole)])
    hits = rows.select("id", "length", (F.col("tf") * _weight(snapshot)).alias("f"), F.explode(F.array_compact(unit)).alias("unit"))
    return _scored(hits.groupBy("id", "length", "unit").agg(F.sum("f").alias("f")), snapshot, len(whole) + 1)


def substring_candidates(snapshot: Snapshot, pattern: str) -> DataFrame | None:
    """``id`` of rows that hold the grams of every literal piece of a LIKE pattern; nothing if it has no literal piece.

    A piece shorter than a gram is looked up as the beginning of grams, as every place of a text begins one.
    """
    pieces = [p for p in re.split("[%_]", _lower(pattern)) if p]
    table = snapshot.table("grams")
    if not pieces or table is None:
        return None
    full = sorted({p[i : i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})
    short = sorted({p for p in pieces if len(p) < GRAM})
    wanted = F.lit(False)
    for p in short:
        wanted = wanted | _starts("gram", p)
    if full:
        wanted = wanted | F.col("gram").isin(full)
    marks = F.array(F.when(F.col("gram").isin(full), F.col("gram")) if full else F.lit(None).cast("string"), *[F.when(_starts("gram", p), F.lit(f"<{p}")) for p in short])
    rows = snapshot.live(gram_rows(table.where(wanted))).select("id", F.explode(F.array_compact(marks)).alias("mark")).distinct()
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(full) + len(short)).select("id")


def _like(snapshot: Snapshot, pattern: str):
    low = "%" + _lower(pattern).replace("\\", "\\\\") + "%"
    out = F.lit(False)
    for c in snapshot.fields:
        out = out | F.coalesce(lower_ascii(F.col(c)).like(low), F.lit(False))
    return out


def substring(snapshot: Snapshot, pattern: str) -> DataFrame:
    """``id`` of rows with a field LIKE ``%pattern%``, A-Z without case; ``%`` and ``_`` in it are wildcards.

    Candidates come from the grams. Where they are few, only the ``part`` folders and row groups of their ids are read to
    verify them; otherwise they are joined. A pattern of wildcards alone is compared with all texts.
    """
    texts = snapshot.table("texts")
    if texts is None:
        return _none(snapshot).select("id")
    found = substring_candidates(snapshot, pattern)
    if found is None:
        return snapshot.live(texts).where(_like(snapshot, pattern)).select("id")
    few = [r["id"] for r in found.limit(FEW_IDS + 1).collect()]
    if len(few) > FEW_IDS:
        return snapshot.live(texts.join(found, "id", "left_semi")).where(_like(snapshot, pattern)).select("id")
    ids = snapshot.spark.createDataFrame([(i,) for i in few], "id long").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(snapshot.parts)).cast("int"))
    parts = [r["part"] for r in ids.select("part").distinct().collect()]
    near = texts.where(F.col("part").isin(parts) & F.col("id").between(min(few, default=0), max(few, default=-1)))
    return snapshot.live(near.join(F.broadcast(ids.select("id")), "id", "left_semi")).where(_like(snapshot, pattern)).select("id")


def search(snapshot: Snapshot, query: str, limit: int, keep: DataFrame | None = None) -> DataFrame:
    """``id, tier, rank, score``: phrase (1.0), prefix (0.8) and substring (0.5) matches, each row once in its best tier, then ``limit`` rows by tier, score and id.

    ``keep`` (``id``) holds the rows that a search may return, for filters by kind or scope; it acts before the limit.
    """
    text = query.strip()
    if not text:
        return _none(snapshot).select("id", F.lit(1).alias("tier"), F.lit(1.0).alias("rank"), "score")
    tiers = [(1, 1.0, phrase(snapshot, text)), (2, 0.8, prefix(snapshot, text)), (3, 0.5, substring(snapshot, text).withColumn("score", F.lit(0.0)))]
    rows = None
    for tier, _, found in tiers:
        r = found.select("id", F.struct(F.lit(tier).alias("tier"), F.round("score", 5).alias("score")).alias("hit"))
        rows = r if rows is None else rows.unionByName(r)
    best = rows.groupBy("id").agg(F.min("hit").alias("hit")).select("id", "hit.*")
    if keep is not None:
        best = best.join(keep.select("id"), "id", "left_semi")
    rank = F.element_at(F.array(*[F.lit(r) for _, r, _ in tiers]), F.col("tier"))
    return best.select("id", "tier", rank.alias("rank"), "score").orderBy("tier", F.desc("score"), "id").limit(limit)


#: Weights of the signals.
FUSION = {"fts": 0.40, "ppr": 0.30, "hotspot": 0.15, "recency": 0.10, "exact": 0.05}
SEEDS = 10


def found_by(snapshot: Snapshot, queries: list[str], limit: int, keep: DataFrame | None = None) -> DataFrame:
    """``query, id, tier, rank, score, position`` of several searches, each with its own limit."""
    rows = None
    for q in queries:
        r = search(snapshot, q, limit, keep).withColumn("query", F.lit(q))
        rows = r if rows is None else rows.unionByName(r)
    place = Window.partitionBy("query").orderBy("tier", F.desc("score"), "id")  # limited rows
    return cut(rows.withColumn("position", F.row_number().over(place)))


def near_seeds(found: DataFrame, graph: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """``found`` with ``ppr``: the nearness of each row to its query's first rows in the graph, all queries pushed at once; 0 where none reaches it."""
    scores = push(graph, found.where(F.col("position") <= seeds).select("query", "id"))
    return found.join(scores.withColumnRenamed("score", "ppr"), ["query", "id"], "left").withColumn("ppr", F.coalesce("ppr", F.lit(0.0)))


def fused(found: DataFrame, features: DataFrame, weights: dict[str, float] = FUSION) -> DataFrame:
    """``query, id, fused`` with the five signals, each but ``exact`` min-max normalised within its query (a constant one is 0.5).

    ``features`` has ``id, hotspot, recency``; rows without any have 0 of both.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    r = found.join(features, "id", "left").select("query", "id", F.col("rank").alias("fts"), "ppr", zero("hotspot"), zero("recency"), F.when(F.col("tier") == 1, 1.0).otherwise(0.0).alias("exact"))
    all_of = Window.partitionBy("query")  # limited rows
    for c in ("fts", "ppr", "hotspot", "recency"):
        low, high = F.min(c).over(all_of), F.max(c).over(all_of)
        r = r.withColumn(c, F.when(high == low, 0.5).otherwise((F.col(c) - low) / (high - low)))
    return r.withColumn("fused", sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)))
