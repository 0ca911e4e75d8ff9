"""Queries through the search index: phrases, prefixes, substrings, tiers, and an index that is kept current."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loam.functions.shared import shared_dir
from loam.operators import graph, retrieval
from loam.plans.catalog import query
from loam.sources import relations as R
from loam.sources import search_store, writers

#: Weights of name, documentation and signature.
FIELDS = {"name": 1.0, "documentation": 0.5, "signature": 0.3}

_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9_]+')"
_INDEXED = (
    f"tok AS (SELECT id, {_TOK.format('name')} AS a, {_TOK.format('documentation')} AS b, {_TOK.format('signature')} AS c FROM texts), "
    "size AS (SELECT count(*) AS n, sum(len(a) + len(b) + len(c)) / count(*) AS mean FROM tok), "
)
_TEXTS = "texts AS (SELECT doc_id AS id, array_to_string(str_split(text, ' ')[:5], ' ') AS name, text AS documentation, source || ' ' || lang AS signature FROM documents), " + _INDEXED


def _score(unit: str, hits: str) -> str:
    """BM25 of one unit of a query, whose weighted frequency in each row ``hits`` counts."""
    return (
        f"{unit}_f AS MATERIALIZED (SELECT id, f, length FROM (SELECT id, {hits} AS f, len(a) + len(b) + len(c) AS length FROM tok) WHERE f > 0), "
        f"{unit} AS (SELECT id, ln(1 + (n - (SELECT count(*) FROM {unit}_f) + 0.5) / ((SELECT count(*) FROM {unit}_f) + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean)) AS score FROM {unit}_f, size)"
    )


def _phrase(words: list[str]) -> str:
    k = len(words)
    places = f"len(list_filter(range(1, greatest(len({{f}}) - {k} + 2, 1)), lambda i: {{f}}[i:i + {k - 1}] = {words}))"
    return f"1.0 * {places.format(f='a')} + 0.5 * {places.format(f='b')} + 0.3 * {places.format(f='c')}"


def _begins(word: str, whole: bool = False) -> str:
    test = f"x = '{word}'" if whole else f"starts_with(x, '{word}')"
    return " + ".join(f"{w} * len(list_filter({f}, lambda x: {test}))" for f, w in zip("abc", FIELDS.values(), strict=True))


def _texts(documents):
    name = F.substring_index("text", " ", 5)
    return documents.select(F.col("doc_id").alias("id"), name.alias("name"), F.col("text").alias("documentation"), F.concat("source", F.lit(" "), "lang").alias("signature"))


def _index(spark, sf_dir):
    d = R.read(spark, sf_dir, "documents")
    return search_store.index_of(d, _texts(d), "texts", FIELDS)


@query("WITH " + _TEXTS + _score("u", _phrase(["the", "the", "of"])) + " SELECT id, round(score, 5) AS score FROM u")
def phrase_search(spark, sf_dir):
    return retrieval.phrase(_index(spark, sf_dir), "The the of").withColumn("score", F.round("score", 5))


@query("WITH " + _TEXTS + _score("u", _begins("the", True)) + ", " + _score("v", _begins("licen")) + " SELECT id, round(u.score + v.score, 5) AS score FROM u JOIN v USING (id)")
def prefix_search(spark, sf_dir):
    return retrieval.prefix(_index(spark, sf_dir), "the licen").withColumn("score", F.round("score", 5))


_HOLDS = "(contains(lower(name), '{0}') OR contains(lower(documentation), '{0}') OR contains(lower(signature), '{0}'))"


@query("WITH " + _TEXTS + f"x AS (SELECT 'nsed un' AS pattern, id FROM texts WHERE {_HOLDS.format('nsed un')} UNION ALL SELECT 'zq', id FROM texts WHERE {_HOLDS.format('zq')} UNION ALL SELECT 'mit_licen%19', id FROM texts WHERE name ILIKE '%mit_licen%19%' OR documentation ILIKE '%mit_licen%19%' OR signature ILIKE '%mit_licen%19%') SELECT pattern, id FROM x")
def substring_index(spark, sf_dir):
    at, out = _index(spark, sf_dir), None
    for pattern in ("nsed un", "zq", "mit_licen%19"):
        found = retrieval.substring(at, pattern.upper()).select(F.lit(pattern).alias("pattern"), "id")
        out = found if out is None else out.unionByName(found)
    return out


_TIERED = (
    _score("u", _phrase(["src1", "en"])) + ", " + _score("v", _begins("src1", True)) + ", " + _score("w", _begins("en")) + f", h AS (SELECT id, 1 AS tier, round(score, 5) AS score FROM u"
    " UNION ALL SELECT id, 2, round(v.score + w.score, 5) FROM v JOIN w USING (id)"
    f" UNION ALL SELECT id, 3, 0.0 FROM texts WHERE {_HOLDS.format('src1 en')})"
)


@query("WITH " + _TEXTS + _TIERED + ", b AS (SELECT id, min(struct_pack(tier := tier, score := score)) AS m FROM h GROUP BY id) SELECT id, m.tier AS tier, CAST([1.0, 0.8, 0.5][m.tier] AS DOUBLE) AS rank, m.score AS score FROM b ORDER BY m.tier, m.score DESC, id LIMIT 200")
def tiered_search(spark, sf_dir):
    return retrieval.search(_index(spark, sf_dir), "src1 en", 200)


def _kept_current(spark, sf_dir):
    """An index that starts from an older state of ``documents`` and is brought to the present by three batches, then merged.

    The older state lacks one source, has another one's texts under a first line of their own, and holds the benchmark's items as
    documents that are deleted later.
    """
    now = _texts(R.read(spark, sf_dir, "documents"))
    new, changed = F.col("signature").startswith("src3 "), F.col("signature").startswith("src1 ")
    added = R.read(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("id"), F.lit("the following item").alias("name"), F.col("text").alias("documentation"), F.lit("bench").alias("signature"))
    old = now.where(~F.coalesce(new, F.lit(False))).withColumn("documentation", F.when(changed, F.concat(F.lit("the following license was removed\n"), "documentation")).otherwise(F.col("documentation")))
    at = search_store.create(spark, f"{shared_dir(spark)}/loam-current-{uuid.uuid4().hex}", FIELDS)
    at = search_store.apply(at, old.unionByName(added))
    at = search_store.apply(at, now.where(changed))
    at = search_store.apply(at, None, added)
    at = search_store.apply(at, now.where(new), now.where(new))
    return search_store.merge(at)


@query("WITH " + _TEXTS + _score("u", _phrase(["the", "the", "of"])) + ", " + _score("v", _begins("licen")) + " SELECT 'phrase' AS kind, id, round(score, 5) AS score FROM u UNION ALL SELECT 'prefix', id, round(score, 5) FROM v")
def index_increment(spark, sf_dir):
    at = _kept_current(spark, sf_dir)
    phrases, prefixes = retrieval.phrase(at, "the the of"), retrieval.prefix(at, "licen")
    return phrases.withColumn("kind", F.lit("phrase")).unionByName(prefixes.withColumn("kind", F.lit("prefix"))).select("kind", "id", F.round("score", 5).alias("score"))


# -- searches over symbols, ranked with their surroundings ---------------------------------------------------------------

SEARCHES = ["hot ring", "old rod"]
LIMIT = 40
_SYMBOLS = "texts AS (SELECT p_partkey AS id, p_name AS name, p_type AS documentation, p_brand AS signature FROM part), " + _INDEXED
_PUSH = (
    "r{j} AS MATERIALIZED (SELECT coalesce(f.query, h.query) AS query, coalesce(f.id, h.id) AS id, 0.85 * coalesce(flow, 0) + 0.15 * coalesce(home, 0) AS score"
    " FROM (SELECT query, dst AS id, sum(score * p) AS flow FROM r{i} JOIN pe ON src = id GROUP BY 1, 2) f FULL JOIN home h ON h.id = f.id AND h.query = f.query)"
)


def _found(k: int, words: list[str]) -> str:
    """Tiers of one search for two words, without parts of one type, limited."""
    text, a, b = " ".join(words), *words
    return (
        f"{_score(f'u{k}', _phrase(words))}, {_score(f'v{k}', _begins(a, True))}, {_score(f'w{k}', _begins(b))}, "
        f"h{k} AS (SELECT id, 1 AS tier, round(score, 5) AS score FROM u{k} UNION ALL SELECT id, 2, round(v{k}.score + w{k}.score, 5) FROM v{k} JOIN w{k} USING (id)"
        f" UNION ALL SELECT id, 3, 0.0 FROM texts WHERE {_HOLDS.format(text)}), "
        f"b{k} AS (SELECT '{text}' AS query, id, min(struct_pack(tier := tier, score := score)) AS m FROM h{k} WHERE id IN (SELECT p_partkey FROM part WHERE p_type <> 'ECONOMY') GROUP BY id), "
        f"l{k} AS (SELECT query, id, m.tier AS tier, [1.0, 0.8, 0.5][m.tier]::DOUBLE AS rank, row_number() OVER (ORDER BY m.tier, m.score DESC, id) AS position FROM b{k} ORDER BY position LIMIT {LIMIT})"
    )


_NEAR = (
    "WITH " + R.CTE["flow"] + ", " + _SYMBOLS + ", ".join(_found(k, q.split()) for k, q in enumerate(SEARCHES)) + ", found AS MATERIALIZED (" + " UNION ALL ".join(f"FROM l{k}" for k in range(len(SEARCHES))) + "), "
    "pe AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM flow), v AS (SELECT src AS id FROM flow UNION SELECT dst FROM flow), "
    "home AS MATERIALIZED (SELECT query, id, 1 / count(*) OVER (PARTITION BY query) AS home FROM found WHERE position <= 10 AND id IN (FROM v)), r0 AS (SELECT query, id, home AS score FROM home), "
    + ", ".join(_PUSH.format(i=i, j=i + 1) for i in range(20))
    + ", near AS (SELECT found.*, coalesce(score, 0) AS ppr FROM found LEFT JOIN r20 USING (query, id))"
)
_SCALED = "CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 0.5 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"


def _near(spark, sf_dir):
    part = R.read(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("documentation"), F.col("p_brand").alias("signature"))
    at = search_store.index_of(part, rows, "symbols", FIELDS)
    found = retrieval.found_by(at, SEARCHES, LIMIT, part.where("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("id")))
    flow = graph.transitions(R.kept(spark, sf_dir, R.flow).withColumnRenamed("n", "weight"))
    return retrieval.near_seeds(found, writers.clustered(R.read(spark, sf_dir, "lineitem"), flow, "flow-steps", "src", "dst"))


@query(
    _NEAR + ", feat AS (SELECT l_partkey AS id, count(DISTINCT l_orderkey)::DOUBLE AS hotspot, date_diff('day', DATE '1970-01-01', max(o_orderdate)::DATE)::DOUBLE AS recency FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1), "
    "x AS (SELECT query, id, rank AS fts, ppr, coalesce(hotspot, 0) AS hotspot, coalesce(recency, 0) AS recency, CASE WHEN tier = 1 THEN 1.0 ELSE 0.0 END AS exact FROM near LEFT JOIN feat USING (id)) "
    f"SELECT query, id, round(0.40 * {_SCALED.format(c='fts')} + 0.30 * {_SCALED.format(c='ppr')} + 0.15 * {_SCALED.format(c='hotspot')} + 0.10 * {_SCALED.format(c='recency')} + 0.05 * exact, 6)::DOUBLE AS fused FROM x WINDOW w AS (PARTITION BY query)"
)
def composed_search(spark, sf_dir):
    """Searches over symbols: filter by kind, tiers from the index, then words, nearness in the call graph, churn, recency and exactness together."""
    near = _near(spark, sf_dir)
    changes = R.commit_files(spark, sf_dir).join(F.broadcast(near.select(F.col("id").alias("path")).distinct()), "path", "left_semi")  # limited rows
    features = changes.groupBy(F.col("path").alias("id")).agg(F.count_distinct("commit_id").alias("hotspot"), F.unix_date(F.max("ts").cast("date")).alias("recency"))
    return retrieval.fused(near, features).select("query", "id", F.round("fused", 6).alias("fused"))


@query(_NEAR + " SELECT query, id, position, round(0.6 / position + 0.4 * ppr, 6) AS final FROM near")
def graph_rerank(spark, sf_dir):
    """The same searches by place and nearness in the call graph."""
    return _near(spark, sf_dir).select("query", "id", F.col("position").cast("long").alias("position"), F.round(0.6 / F.col("position") + 0.4 * F.col("ppr"), 6).alias("final"))
