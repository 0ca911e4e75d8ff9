"""Queries over change history."""

from __future__ import annotations

from loam.operators import churn
from loam.plans.catalog import query
from loam.sources import relations as R

_POINTS = "CASE WHEN age_days <= 1 THEN 10 WHEN age_days <= 7 THEN 8 WHEN age_days <= 30 THEN 6 WHEN age_days <= 90 THEN 4 WHEN age_days <= 180 THEN 2 ELSE 1 END"


@query(
    R.using("commit_files")
    + """, agg AS (SELECT path, count(DISTINCT commit_id) AS changes, count(DISTINCT author) AS authors, max(ts) AS last_ts, avg(additions + deletions) AS m FROM commit_files WHERE ts >= TIMESTAMP '1998-01-01' GROUP BY path)
SELECT path, changes, authors, round(m, 6) AS mean_lines, round(sqrt(changes) * ln(authors + 1) * ln(m + 1), 6) AS score,
 CASE WHEN date_diff('day', CAST(last_ts AS DATE), DATE '2001-12-01') <= 7 THEN 'recent' WHEN date_diff('day', CAST(last_ts AS DATE), DATE '2001-12-01') <= 30 THEN 'moderate' ELSE 'stale' END AS recency,
 CASE WHEN changes > 10 THEN 'high' WHEN changes > 5 THEN 'medium' ELSE 'low' END AS risk
FROM agg ORDER BY score DESC, path LIMIT 50"""
)
def hotspots_churn(spark, sf_dir):
    return churn.hotspots(R.commit_files(spark, sf_dir), "1998-01-01", R.HISTORY_AS_OF, 50)


@query(
    R.using("commit_files")
    + "SELECT path, count(DISTINCT commit_id) AS changes, count(DISTINCT author) AS authors, strftime(max(ts), '%Y-%m-%d') AS last_day, round(avg(additions + deletions), 6) AS mean_lines, round(sqrt(count(DISTINCT commit_id)) * ln(count(DISTINCT author) + 1) * ln(avg(additions + deletions) + 1), 6) AS score FROM commit_files GROUP BY path"
)
def churn_all_files(spark, sf_dir):
    from pyspark.sql import functions as F

    by = churn.file_churn(R.commit_files(spark, sf_dir))
    return by.select("path", "changes", "authors", F.date_format("last_ts", "yyyy-MM-dd").alias("last_day"), "mean_lines", "score")


@query(R.using("commit_files") + "SELECT path, count(DISTINCT commit_id) AS changes, count(DISTINCT author) AS authors, round(avg(additions + deletions), 6) AS mean_lines FROM commit_files WHERE path = 7 GROUP BY path")
def churn_single_file(spark, sf_dir):
    return churn.file_churn(R.commit_files(spark, sf_dir).where("path = 7")).select("path", "changes", "authors", "mean_lines")


@query(R.using("commit_files") + "SELECT DISTINCT path FROM commit_files WHERE ts >= TIMESTAMP '2001-06-01'")
def churn_since(spark, sf_dir):
    return R.commit_files(spark, sf_dir).where("ts >= timestamp '2001-06-01'").select("path").distinct()


@query(
    R.using("commit_files")
    + f""", agg AS (SELECT path, count(DISTINCT commit_id) AS changes, count(DISTINCT author) AS authors, date_diff('day', CAST(max(ts) AS DATE), DATE '2001-12-01') AS age_days FROM commit_files WHERE ts >= TIMESTAMP '2001-01-01' GROUP BY path)
SELECT path, changes, authors, age_days, round({_POINTS} * 10.0 + changes + authors * 0.5, 6)::DOUBLE AS score FROM agg ORDER BY score DESC, path LIMIT 100"""
)
def recently_relevant(spark, sf_dir):
    return churn.recently_relevant(R.commit_files(spark, sf_dir), "2001-01-01", R.HISTORY_AS_OF, 100)


@query(
    R.using("symbols")
    + """, c AS (SELECT regexp_split_to_array(name, '[ _]')[-1] AS w, module FROM symbols), d AS (SELECT upper(w[1]) || lower(w[2:]) AS concept, module FROM c WHERE length(w) > 2),
agg AS (SELECT concept, count(*) AS symbols, count(DISTINCT module) AS modules, array_to_string(list_sort(list(DISTINCT module))[1:5], ',') AS top_modules FROM d GROUP BY concept HAVING count(*) >= 2)
SELECT concept, symbols, modules, symbols * modules AS score, top_modules FROM agg ORDER BY score DESC, concept LIMIT 12"""
)
def key_concepts(spark, sf_dir):
    return churn.key_concepts(R.symbols(spark, sf_dir), 2, 12)


@query(R.using("commit_files") + "SELECT count(DISTINCT commit_id) AS commits, count(DISTINCT author) AS authors, count(DISTINCT path) AS files FROM commit_files WHERE ts >= TIMESTAMP '2000-01-01'")
def history_totals(spark, sf_dir):
    return churn.history_totals(R.commit_files(spark, sf_dir), "2000-01-01")


@query(R.using("commits") + "SELECT commit_id, author, strftime(ts, '%Y-%m-%d') AS day, message FROM (SELECT * FROM commits WHERE ts >= TIMESTAMP '2001-01-01' ORDER BY ts DESC, commit_id DESC LIMIT 25)")
def latest_commits(spark, sf_dir):
    from pyspark.sql import functions as F

    return churn.latest_commits(R.commits(spark, sf_dir), "2001-01-01", 25).select("commit_id", "author", F.date_format("ts", "yyyy-MM-dd").alias("day"), "message")
