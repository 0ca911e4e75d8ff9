"""Queries that parse or write text."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import docs
from loam.plans.catalog import query
from loam.sources import readers, writers
from loam.sources import relations as R


@query("SELECT 'calls_total{function=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def prometheus_lines(spark, sf_dir):
    n = R.calls(spark, sf_dir).groupBy("function").agg(F.count(F.lit(1)).alias("n"))
    return writers.prometheus(n, "calls_total", ["function"], "n")


@query(R.using("symbols") + ", r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY score DESC, symbol_id) AS i FROM symbols) SELECT module, '## ' || module || chr(10) || string_agg('- ' || name || ' (' || kind || ')', chr(10) ORDER BY i) AS text FROM r WHERE i <= 4 GROUP BY 1")
def llm_export(spark, sf_dir):
    return writers.llm_export(R.symbols(spark, sf_dir), 4)


@query("SELECT page_id AS path, len(regexp_extract_all(html, '\\b(?:if|elif|for|while|case|catch|except)\\b|&&|\\|\\||\\band\\b|\\bor\\b|\\?')) + 1 AS cyclomatic FROM pages")
def page_complexity(spark, sf_dir):
    p = R.read(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("text"))
    return readers.complexity(p).withColumn("cyclomatic", F.col("cyclomatic").cast("long"))


@query("WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)) AS target FROM pages) SELECT target, count(*) AS n, count(DISTINCT page_id) AS pages FROM m GROUP BY 1")
def page_references(spark, sf_dir):
    p = R.read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("target"))
    return p.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


_DOC = "replace(text, ' the ', ' `the.x` ') || chr(10) || '```go' || chr(10) || 'pkg.Item' || item_id || '(`in.fence`)' || chr(10) || '```' || chr(10) || '<!-- doc:symbol a.b' || item_id || ' --> see `read.me` and `notes.md`' || CASE WHEN item_id % 2 = 0 THEN '<!-- doc:known_symbols me, X -->' ELSE '' END"


@query(
    f"""WITH t AS (SELECT item_id, {_DOC} AS text, len(string_split(text, chr(10))) AS n FROM benchmark), l AS (SELECT item_id, n, unnest(string_split(text, chr(10))) AS body, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM t),
m AS (SELECT item_id, line, unnest(regexp_extract_all(body, '`([A-Za-z_][A-Za-z0-9_]*(?:(?:::|->|[.#/])[A-Za-z_][A-Za-z0-9_]*)+)`', 1)) AS mention, 'backtick' AS method FROM l UNION ALL SELECT item_id, n + 1, unnest(['pkg.Item' || item_id, 'in.fence']), 'fence' FROM t UNION ALL SELECT item_id, n + 4, 'a.b' || item_id, 'directive' FROM t)
SELECT item_id, line::INT AS line, mention, method, item_id % 2 = 0 AND mention IN ('read.me', 'the.x') AS known FROM m WHERE mention <> 'notes.md' """
)
def doc_mentions(spark, sf_dir):
    parts = "replace(text, ' the ', ' `the.x` '), '\\n```go\\npkg.Item', item_id, '(`in.fence`)\\n```\\n<!-- doc:symbol a.b', item_id, ' --> see `read.me` and `notes.md`', case when item_id % 2 = 0 then '<!-- doc:known_symbols me, X -->' else '' end"
    b = R.read(spark, sf_dir, "benchmark").withColumn("text", F.expr(f"concat({parts})"))
    return docs.mentions(b, "item_id", "text")


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, arg_min(role, turn) AS first_role, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def conversation_rollup(spark, sf_dir):
    c = R.read(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("role").alias("roles"), F.min_by("role", "turn").alias("first_role"), F.sum(F.length("text")).alias("chars"))
