"""Queries over coupling, ownership and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import audit, churn, coupling, ownership
from loam.plans.catalog import query
from loam.sources import relations as R

_PAIRS = """kept AS (SELECT DISTINCT commit_id, path FROM commit_files), base AS (SELECT path, count(*) AS changes FROM kept GROUP BY 1),
pairs AS (SELECT a.path, b.path AS other, count(*) AS together FROM kept a JOIN kept b ON a.commit_id = b.commit_id AND a.path <> b.path GROUP BY 1, 2),
coupled AS (SELECT path, other, together, changes, round(together / changes, 6) AS correlation FROM pairs JOIN base USING (path))"""


@query(R.using("commit_files") + ", " + _PAIRS + " SELECT path, other, together, changes, correlation, CASE WHEN correlation >= 0.8 THEN 'high' WHEN correlation >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM coupled WHERE correlation >= 0.05 AND together >= 2")
def cochange_coupling(spark, sf_dir):
    return coupling.coupled(R.commit_files(spark, sf_dir), 0.05, 2)


@query(R.using("commit_files") + ", " + _PAIRS + " SELECT CASE WHEN correlation >= 0.8 THEN 'high' WHEN correlation >= 0.5 THEN 'medium' ELSE 'low' END AS level, count(*) AS pairs FROM coupled WHERE correlation >= 0.01 GROUP BY 1")
def coupling_levels(spark, sf_dir):
    return coupling.coupled(R.commit_files(spark, sf_dir), 0.01, 1).groupBy("level").agg(F.count(F.lit(1)).alias("pairs"))


@query(R.using("commit_files") + ", " + _PAIRS + " SELECT other, together, changes, correlation FROM coupled WHERE path = 7 ORDER BY correlation DESC, other LIMIT 20")
def coupling_of_file(spark, sf_dir):
    target = spark.createDataFrame([(7,)], "path long")
    pairs = coupling.co_changes(R.commit_files(spark, sf_dir), target)
    return pairs.orderBy(F.desc("correlation"), "other").limit(20).select("other", "together", "changes", "correlation")


_SHARES = """w AS (SELECT file, author, sum(pow(0.5, greatest(date_diff('day', CAST(ts AS DATE), DATE '2001-12-01'), 0) / 90.0)) AS weight, count(*) AS lines FROM blame GROUP BY 1, 2),
shares AS (SELECT *, weight / sum(weight) OVER (PARTITION BY file) AS share FROM w)"""


@query(R.using("blame") + ", " + _SHARES + " SELECT file, author, lines, round(share, 6) AS share, CASE WHEN share >= 0.5 THEN 'maintainer' WHEN share >= 0.2 THEN 'reviewer' ELSE 'contributor' END AS scope FROM shares WHERE share >= 0.05")
def ownership_decay(spark, sf_dir):
    return ownership.owners(R.blame(spark, sf_dir), R.HISTORY_AS_OF)


_NAME = "CASE o_custkey % 11 WHEN 0 THEN 'dependabot' WHEN 1 THEN 'x[bot]' ELSE 'User ' || (o_custkey % 300) END"
_EMAIL = "CASE o_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'noreply@github.com' WHEN 2 THEN 'renovate@bots.org' ELSE 'U' || (o_custkey % 200) || '@X.org' END"


@query(
    f"""WITH raw AS (SELECT l_partkey AS file, {_NAME} AS name, {_EMAIL} AS email, l_shipdate AS ts FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
blame AS (SELECT file, lower(CASE WHEN email NOT IN ('', 'noreply@github.com') THEN email ELSE name END) AS author, ts FROM raw WHERE NOT regexp_matches(name, '\\[bot\\]$|^dependabot|^renovate') AND NOT regexp_matches(email, '^renovate')), """
    + _SHARES
    + " SELECT file, author, lines, round(share, 6) AS share, CASE WHEN share >= 0.5 THEN 'maintainer' WHEN share >= 0.2 THEN 'reviewer' ELSE 'contributor' END AS scope FROM shares WHERE share >= 0.05"
)
def ownership_people(spark, sf_dir):
    """Decayed ownership by persons: automatons' lines do not count, addresses join a person's names."""
    li = R.read(spark, sf_dir, "lineitem").join(R.read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    spell = lambda x: F.expr(x.replace("CASE o_custkey % 11", "CASE int(o_custkey % 11)").replace("CASE o_custkey % 7", "CASE int(o_custkey % 7)"))
    raw = li.select(F.col("l_partkey").alias("file"), spell(_NAME).alias("name"), spell(_EMAIL).alias("email"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return ownership.owners(ownership.people(raw), R.HISTORY_AS_OF)


_DECLARED = "declared AS (SELECT file, min(author) AS author FROM blame GROUP BY 1)"
_DRIFT = """drifted AS (SELECT s.file, round(sum(CASE WHEN d.author IS NULL THEN share ELSE 0 END), 6) AS drift, arg_max(s.author, (share, -s.author)) AS top_author
FROM shares s LEFT JOIN declared d ON d.file = s.file AND d.author = s.author GROUP BY 1)"""


@query(R.using("blame") + f", {_SHARES}, {_DECLARED}, {_DRIFT} SELECT file, drift, top_author, CASE WHEN drift >= 0.8 THEN 'replaced' WHEN drift >= 0.5 THEN 'shifted' ELSE 'partial' END AS finding FROM drifted WHERE drift >= 0.3")
def ownership_drift(spark, sf_dir):
    blame = R.blame(spark, sf_dir)
    declared = blame.groupBy("file").agg(F.min("author").alias("author"))
    return ownership.drift(declared, ownership.decayed_shares(blame, R.HISTORY_AS_OF), 0.3)


@query(R.using("blame") + f", {_SHARES}, {_DECLARED}, {_DRIFT} SELECT p_brand AS module, count(*) AS files, round(avg(drift), 6) AS mean_drift FROM drifted JOIN part ON p_partkey = file GROUP BY 1")
def ownership_drift_modules(spark, sf_dir):
    blame = R.blame(spark, sf_dir)
    declared = blame.groupBy("file").agg(F.min("author").alias("author"))
    drifted = ownership.drift(declared, ownership.decayed_shares(blame, R.HISTORY_AS_OF), 0.0)
    modules = R.symbols(spark, sf_dir).select(F.col("symbol_id").alias("file"), "module")
    return ownership.module_drift(drifted.join(modules, "file"))


@query(R.using("blame") + ", a AS (SELECT file, author, count(*) AS lines FROM blame GROUP BY 1, 2) SELECT file, count(*) AS authors, round(max(lines) / sum(lines), 6) AS top_share, count(*) <= 1 AS alone FROM a GROUP BY 1")
def bus_factor(spark, sf_dir):
    return ownership.bus_factor(R.blame(spark, sf_dir))


@query(R.using("blame") + " SELECT file, CAST(2001 * 12 + 12 - year(max(ts)) * 12 - month(max(ts)) AS BIGINT) AS months FROM blame GROUP BY 1")
def staleness_months(spark, sf_dir):
    return ownership.staleness_months(R.blame(spark, sf_dir), R.HISTORY_AS_OF)


@query(R.using("blame") + " SELECT author, count(*) AS lines, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, arg_max(file, (ts, file)) AS last_file FROM blame GROUP BY 1")
def contributors(spark, sf_dir):
    return ownership.contributors(R.blame(spark, sf_dir))


@query(R.using("commits") + " SELECT author, arg_min(commit_id, (ts, commit_id)) AS first_commit, count(*) AS commits, count(*) - 1 AS followed FROM commits GROUP BY 1")
def origin_report(spark, sf_dir):
    return ownership.origin(R.commits(spark, sf_dir))


#: Rules over ``brand/type words/name`` paths of parts.
RULES = """# owners
* @org/all
Brand#1*/ @org/one
Brand#11/** @eleven
!Brand#12/
Brand#2*/**/*a* a@x.org
"""
_PATH = "replace(p_brand, ' ', '-') || '/' || replace(p_type, ' ', '/') || '/' || replace(p_name, ' ', '-')"


def _part_paths(spark, sf_dir):
    p = R.read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("symbol_id"), F.expr(f"concat(replace(p_brand, ' ', '-'), '/', replace(p_type, ' ', '/'), '/', replace(p_name, ' ', '-'))").alias("path"))


def _rules_sql() -> str:
    rules = ownership.parse_rules(RULES.replace("#1", "~1").replace("#2", "~2"))
    case, number = "''", "0"
    for line, pattern, who, negated in rules:
        hit = f"regexp_matches(path, '{ownership.glob_regex(pattern.replace('~', '#'))}')"
        owner = ",".join(who) if not negated else ""
        case, number = f"CASE WHEN {hit} THEN '{owner}' ELSE {case} END", f"CASE WHEN {hit} THEN {line} ELSE {number} END"
    return f"SELECT symbol_id, {case} AS owners, CAST({number} AS INT) AS rule FROM (SELECT p_partkey AS symbol_id, {_PATH} AS path FROM part)"


@query(_rules_sql())
def codeowners_last_match(spark, sf_dir):
    rules = [(n, p.replace("~", "#"), o, neg) for n, p, o, neg in ownership.parse_rules(RULES.replace("#1", "~1").replace("#2", "~2"))]
    out = ownership.last_match(_part_paths(spark, sf_dir), rules)
    return out.select("symbol_id", F.coalesce(F.array_join("owners", ","), F.lit("")).alias("owners"), F.coalesce("rule", F.lit(0)).alias("rule"))


PATTERNS = [("*", "@org/all", 0.5), ("Brand#1*/**", "@org/one", 0.7), ("Brand#11/*", "@eleven", 0.9), ("Brand#2*/", "b@x.org", 0.8), ("Brand#21/**", "team", 0.6)]


def _specific_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT path, '{p}' AS pattern, '{o}' AS owner, {c} AS confidence FROM paths WHERE regexp_matches(path, '{ownership.glob_regex(p)}')" for p, o, c in PATTERNS)
    return f"""WITH paths AS (SELECT DISTINCT {_PATH} AS path FROM part), hits AS ({rows}),
best AS (SELECT path, arg_max({{'pattern': pattern, 'owner': owner}}, (length(pattern), confidence, pattern)) AS b FROM hits GROUP BY 1)
SELECT path, b.pattern AS pattern, b.owner AS owner, CAST(CASE WHEN b.pattern = '*' THEN 0.1 WHEN b.pattern LIKE '%**%' THEN 0.5 WHEN b.pattern LIKE '%*%' THEN 0.7 ELSE least(1 + length(b.pattern) / 100, 2.0) END AS DOUBLE) AS specificity,
CASE WHEN regexp_matches(b.owner, '^@[^/]+/.+') THEN 'team' WHEN b.owner LIKE '@%' THEN 'user' WHEN b.owner LIKE '%@%' THEN 'email' ELSE 'unknown' END AS owner_type FROM best"""


@query(_specific_sql())
def most_specific_pattern(spark, sf_dir):
    return ownership.most_specific(_part_paths(spark, sf_dir).select("path").distinct(), PATTERNS)


@query(R.using("blame") + f", {_SHARES}, files AS (SELECT DISTINCT l_partkey AS file FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01') SELECT author, count(DISTINCT file) AS files, round(count(DISTINCT file) / (SELECT count(*) FROM files), 6) AS coverage FROM shares WHERE share >= 0.05 AND file IN (SELECT file FROM files) GROUP BY 1 ORDER BY coverage DESC, author LIMIT 5")
def reviewer_coverage(spark, sf_dir):
    files = R.read(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp '2001-06-01'").select(F.col("l_partkey").alias("file")).distinct()
    own = ownership.owners(R.blame(spark, sf_dir), R.HISTORY_AS_OF)
    return ownership.review_coverage(files, own).orderBy(F.desc("coverage"), "author").limit(5)


_MEASURES = """m AS (SELECT b.file, count(DISTINCT author) AS authors, CAST(2001 * 12 + 12 - year(max(ts)) * 12 - month(max(ts)) AS BIGINT) AS months, count(*) FILTER (WHERE date_diff('day', CAST(ts AS DATE), DATE '2001-12-01') <= 90) AS commits_90d FROM blame b GROUP BY 1),
f AS (SELECT m.*, CAST(p_size AS DOUBLE) AS complexity, p_size % 3 = 0 AS tested, lower(p_type) LIKE '%promo%' AS sensitive, CAST(p_size % 7 AS BIGINT) AS coupled FROM m JOIN part ON p_partkey = file),
p AS (SELECT file, least(complexity / 50, 1) * 20 AS complexity, CASE WHEN tested THEN 0.0 ELSE 15.0 END AS tests, CASE WHEN authors <= 1 THEN 15.0 WHEN authors = 2 THEN 7.0 ELSE 0.0 END AS bus_factor, least(months / 12, 1) * 10 AS staleness, CASE WHEN sensitive THEN 15.0 ELSE 0.0 END AS security, least(coupled / 10, 1) * 5 AS coupling, least(commits_90d / 20, 1) * 5 AS churn FROM f),
s AS (SELECT *, round(complexity + tests + bus_factor + staleness + security + coupling + churn, 6)::DOUBLE AS score FROM p),
audited AS (SELECT *, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS level FROM s)"""


def _audited(spark, sf_dir):
    b = R.blame(spark, sf_dir)
    near = F.datediff(F.lit(R.HISTORY_AS_OF).cast("date"), F.col("ts").cast("date")) <= 90
    m = b.groupBy("file").agg(F.countDistinct("author").alias("authors"), F.count_if(near).alias("commits_90d"), F.max("ts").alias("last")).withColumn("months", (2001 * 12 + 12 - F.year("last") * 12 - F.month("last")).cast("long"))
    p = R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").cast("double").alias("complexity"), (F.col("p_size") % 3 == 0).alias("tested"), F.lower("p_type").contains("promo").alias("sensitive"), (F.col("p_size") % 7).cast("long").alias("coupled"))
    return audit.audit(m.join(p, "file"))


@query(R.using("blame") + f", {_MEASURES} SELECT file, score, level FROM audited WHERE score >= 40 ORDER BY score DESC, file LIMIT 50")
def audit_risk(spark, sf_dir):
    return _audited(spark, sf_dir).where("score >= 40").orderBy(F.desc("score"), "file").limit(50).select("file", "score", "level")


@query(R.using("blame") + f", {_MEASURES} SELECT level, count(*) AS files, round(avg(score), 4) AS mean_score FROM audited GROUP BY 1")
def audit_summary(spark, sf_dir):
    return audit.audit_summary(_audited(spark, sf_dir))


@query(R.using("blame") + f", {_MEASURES}, a AS (SELECT file, score, 'add tests' AS action FROM audited WHERE tests > 0 AND complexity >= 10 ORDER BY score DESC, file LIMIT 5), b AS (SELECT file, score, 'share knowledge' AS action FROM audited WHERE bus_factor = 15 AND NOT (tests > 0 AND complexity >= 10) ORDER BY score DESC, file LIMIT 5) SELECT * FROM a UNION ALL SELECT * FROM b")
def quick_wins(spark, sf_dir):
    return audit.quick_wins(_audited(spark, sf_dir))


@query(R.using("blame") + f", {_MEASURES}, x AS (SELECT unnest([('complexity', complexity), ('tests', tests), ('bus_factor', bus_factor), ('staleness', staleness), ('security', security), ('coupling', coupling), ('churn', churn)]) AS t FROM audited) SELECT t[1] AS factor, count(*) AS files FROM x WHERE t[2] > 0 GROUP BY 1".replace("t[1]", "struct_extract(t, 1)").replace("t[2]", "struct_extract(t, 2)"))
def audit_factors(spark, sf_dir):
    a = _audited(spark, sf_dir)
    names = ["complexity", "tests", "bus_factor", "staleness", "security", "coupling", "churn"]
    long = a.select(F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("v")) for n in names])).alias("x")).select("x.*")
    return long.where("v > 0").groupBy("factor").agg(F.count(F.lit(1)).alias("files"))


@query(
    R.using("commit_files")
    + """, hot AS (SELECT path FROM commit_files GROUP BY 1 ORDER BY round(sqrt(count(DISTINCT commit_id)) * ln(count(DISTINCT author) + 1) * ln(avg(additions + deletions) + 1), 6) DESC, path LIMIT 50),
m AS (SELECT commit_id, count(DISTINCT c.path) AS files, CAST(sum(additions + deletions) AS BIGINT) AS churn, count(DISTINCT CASE WHEN h.path IS NOT NULL THEN c.path END) AS hot, count(DISTINCT p_brand) AS modules FROM commit_files c JOIN part ON p_partkey = c.path LEFT JOIN hot h ON h.path = c.path GROUP BY 1),
s AS (SELECT *, round(CASE WHEN files > 20 THEN 0.3 WHEN files > 5 THEN 0.15 ELSE 0 END + CASE WHEN churn > 500 THEN 0.3 WHEN churn > 100 THEN 0.15 ELSE 0 END + least(hot * 0.1, 0.3) + CASE WHEN modules > 3 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS score FROM m)
SELECT *, CASE WHEN score > 0.6 THEN 'high' WHEN score > 0.3 THEN 'medium' ELSE 'low' END AS risk FROM s"""
)
def pr_risk(spark, sf_dir):
    cf = R.commit_files(spark, sf_dir)
    hot = churn.file_churn(cf).orderBy(F.desc("score"), "path").limit(50)
    modules = R.symbols(spark, sf_dir).select(F.col("symbol_id").alias("path"), "module")
    return audit.pr_risk(cf.join(modules, "path"), hot)
