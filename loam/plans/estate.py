"""Queries over federations, impact and modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import scoring
from loam.operators import federation, impact, modules
from loam.plans.catalog import query
from loam.sources import relations as R

_REGIONS = "c_custkey AS symbol_id, c_mktsegment AS file, c_nationkey AS language, r_name AS repo_id FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"


def _members(spark, sf_dir):
    n = R.read(spark, sf_dir, "nation").join(R.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = R.read(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return c.select(F.col("c_custkey").alias("symbol_id"), F.col("c_mktsegment").alias("file"), F.col("c_nationkey").alias("language"), F.col("r_name").alias("repo"), "c_acctbal")


@query("SELECT repo_id, count(*) AS symbols, count(DISTINCT file) AS files, count(DISTINCT language) AS languages FROM (SELECT " + _REGIONS + ") GROUP BY 1")
def federated_repo_stats(spark, sf_dir):
    m = _members(spark, sf_dir)
    names = [r["r_name"] for r in R.read(spark, sf_dir, "region").collect()]  # the list of members, as a federation's configuration has it
    return federation.repo_stats(federation.tag_union({k: m.where(F.col("repo") == k).drop("repo") for k in names}))


@query(
    R.using("snapshots")
    + "SELECT r_name AS repo_id, target, strftime(date, '%Y-%m-%d') AS date, score FROM snapshots JOIN nation ON n_nationkey = target JOIN region ON r_regionkey = n_regionkey WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY target ORDER BY date DESC) = 1 ORDER BY score DESC, target LIMIT 20"
)
def federated_hotspots(spark, sf_dir):
    n = R.read(spark, sf_dir, "nation").join(R.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("target"), F.col("r_name").alias("repo_id"))
    last = R.snapshots(spark, sf_dir).where("score >= 0.3").groupBy("target").agg(F.max_by(F.struct("date", "score"), "date").alias("l"))
    out = last.join(F.broadcast(n), "target").select("repo_id", "target", F.col("l.date").cast("string").alias("date"), F.col("l.score").alias("score"))  # 25 rows
    return out.orderBy(F.desc("score"), "target").limit(20)


_BEHIND, _AGE = "s_suppkey * 7 % 600", "s_suppkey * 3 % 100"


def _stale(spark, sf_dir):
    return R.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("repo"), "s_nationkey", F.expr(_BEHIND).alias("behind"), F.expr(_AGE).alias("age")).withColumn("level", scoring.staleness(F.col("behind"), F.col("age")))


_LEVEL = "CASE WHEN age > 90 OR behind > 500 THEN 3 WHEN age > 30 OR behind > 200 THEN 2 WHEN age > 7 OR behind > 50 THEN 1 ELSE 0 END"


@query(f"WITH r AS (SELECT s_suppkey AS repo, {_BEHIND} AS behind, {_AGE} AS age FROM supplier) SELECT repo, behind, age, CASE {_LEVEL} WHEN 3 THEN 'critical' WHEN 2 THEN 'stale' WHEN 1 THEN 'aging' ELSE 'fresh' END AS level FROM r")
def repo_staleness(spark, sf_dir):
    return _stale(spark, sf_dir).select("repo", "behind", "age", "level")


@query(f"WITH r AS (SELECT {_BEHIND} AS behind, {_AGE} AS age FROM supplier WHERE s_nationkey = 3) SELECT CASE max({_LEVEL}) WHEN 3 THEN 'critical' WHEN 2 THEN 'stale' WHEN 1 THEN 'aging' ELSE 'fresh' END AS worst FROM r HAVING count(*) > 0")
def worst_staleness(spark, sf_dir):
    """The worst level of one federation's members."""
    return federation.worst_staleness(_stale(spark, sf_dir).where("s_nationkey = 3")).where("worst is not null")


_CONTRACT = "e AS (SELECT DISTINCT l_suppkey AS c, o_custkey AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey), d AS (SELECT c, count(*) AS direct FROM e GROUP BY 1), t AS (SELECT a.c, count(DISTINCT b.c) AS transitive FROM e a JOIN e b ON b.k = a.k AND b.c <> a.c GROUP BY 1), x AS (SELECT d.c AS contract, direct, coalesce(transitive, 0) AS transitive FROM d LEFT JOIN t ON t.c = d.c), p AS (SELECT *, CASE WHEN direct >= 5 THEN 3 WHEN direct >= 2 THEN 2 ELSE 0 END + (transitive > 0)::INT + (transitive > 5)::INT + (contract % 2 = 0)::INT + (contract % 5 = 0)::INT AS points FROM x)"


def _contracts(spark, sf_dir):
    li = R.read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("contract"))
    return li.join(R.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("contract", F.col("o_custkey").alias("consumer")).repartition("consumer").distinct()  # dealt out once, as consumers are gathered next


def _risk(e):
    d = e.groupBy("contract").agg(F.count(F.lit(1)).alias("direct"))
    x = d.join(federation.partners(e), "contract", "left").select("contract", "direct", F.coalesce("partners", F.lit(0)).alias("transitive"))
    points, level = federation.contract_points(F.col("direct"), F.col("transitive"), F.col("contract") % 2 == 0, F.col("contract") % 5 == 0)
    return x.select("*", points.alias("points"), level.alias("level"))


@query(f"WITH {_CONTRACT} SELECT contract, direct, transitive, points, CASE WHEN points >= 4 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS level FROM p")
def contract_risk(spark, sf_dir):
    return _risk(_contracts(spark, sf_dir))


@query(
    f"""WITH {_CONTRACT}, s AS (SELECT l_suppkey AS contract, o_custkey AS owner, round(sum(l_quantity * 0.9 * 0.7), 6) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
o AS (SELECT contract, string_agg(owner::VARCHAR, ',' ORDER BY score DESC, owner) AS owners FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY contract ORDER BY score DESC, owner) <= 3) GROUP BY 1),
k AS (SELECT c, string_agg(k::VARCHAR, ',' ORDER BY k) AS consumers FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY c ORDER BY k) <= 5) GROUP BY 1)
SELECT p.contract, direct, transitive, CASE WHEN points >= 4 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS level, consumers, owners FROM p JOIN k ON k.c = p.contract JOIN o ON o.contract = p.contract"""
)
def contract_report(spark, sf_dir):
    """A contract's risk with its first consumers and its owners, in one report."""
    from loam.operators.listing import first_n

    def listed(df, order, n, value, name):
        top = F.array_sort(F.collect_list(F.struct("nth", value)))
        return first_n(df, "contract", order, n).groupBy("contract").agg(F.array_join(F.transform(top, lambda x: x[value].cast("string")), ",").alias(name))

    e = _contracts(spark, sf_dir).where("contract is not null")  # the joins would put this filter into some uses of it, and shuffle it for each
    who = contract_owners(spark, sf_dir).where("rank <= 3").drop("rank")
    first = listed(e, ["consumer"], 5, "consumer", "consumers")
    own = listed(who, [F.desc("score"), "owner"], 3, "owner", "owners")
    return _risk(e).join(first, "contract").join(own, "contract").select("contract", "direct", "transitive", "level", "consumers", "owners")


@query("WITH e AS (SELECT l_suppkey AS contract, l_returnflag AS type, l_discount * 10 AS c FROM lineitem) SELECT type, CASE WHEN c >= 0.95 THEN 'declared' WHEN c >= 0.7 THEN 'derived' WHEN c >= 0.3 THEN 'heuristic' ELSE 'noise' END AS tier, count(*) AS n FROM e GROUP BY 1, 2")
def contract_stats(spark, sf_dir):
    e = R.read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), (F.col("l_discount") * 10).alias("c"))
    return e.groupBy("type", federation.tier(F.col("c")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey AS contract, l_returnflag AS kind, substr(sha256(l_suppkey || '|' || l_linestatus || '|' || l_returnflag || '|' || string_agg(DISTINCT l_linenumber::VARCHAR, '|' ORDER BY l_linenumber::VARCHAR)), 1, 32) AS key FROM lineitem GROUP BY l_suppkey, l_linestatus, l_returnflag")
def contract_edge_key(spark, sf_dir):
    li = R.read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linestatus", "l_returnflag").agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("paths"))
    return li.select(F.col("l_suppkey").alias("contract"), F.col("l_returnflag").alias("kind"), federation.edge_key(F.col("l_suppkey"), F.col("l_linestatus"), F.col("l_returnflag"), F.col("paths")).alias("key"))


@query("WITH s AS (SELECT l_suppkey AS contract, o_custkey AS owner, round(sum(l_quantity * 0.9 * 0.7), 6) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT contract, owner, score, row_number() OVER (PARTITION BY contract ORDER BY score DESC, owner) AS rank FROM s QUALIFY rank <= 5")
def contract_owners(spark, sf_dir):
    li = R.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("contract"), F.col("l_orderkey").alias("path"), F.col("l_quantity").alias("q"))
    own = R.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("owner"), F.lit(0.9).alias("confidence"), F.lit(0.7).alias("specificity"))
    out = federation.owners_of(li.withColumnRenamed("q", "weight"), own)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_name LIKE 'Customer#%1%' AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY 1 LIMIT 50")
def federated_module_search(spark, sf_dir):
    c = R.read(spark, sf_dir, "customer")
    return c.where(F.col("c_name").like(federation.glob_like("Customer#**1*")) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).orderBy("id").limit(50)


# -- impact ----------------------------------------------------------------------------------------------------------------

_KIND = "CASE l_linenumber % 5 WHEN 0 THEN 'call' WHEN 1 THEN 'type' WHEN 2 THEN 'read' WHEN 3 THEN 'write' ELSE 'other' END"
_REFS = f"""refs AS (SELECT l_partkey AS target, l_suppkey AS source, {_KIND} AS kind, l_returnflag = 'A' AS is_test FROM lineitem),
it AS (SELECT refs.*, 'S' || (source % 8) AS source_module, CASE WHEN is_test THEN 'test-dependency' WHEN kind = 'call' THEN 'direct-caller' WHEN kind = 'type' THEN 'type-dependency' WHEN kind = 'read' THEN 'reader' WHEN kind = 'write' THEN 'writer' ELSE 'unknown' END AS impact,
CASE WHEN is_test THEN 0.8 WHEN kind = 'call' THEN 0.95 WHEN kind = 'type' THEN 0.9 WHEN kind IN ('read', 'write') THEN 0.85 ELSE 0.5 END AS confidence FROM refs)"""


def _refs(spark, sf_dir):
    li = R.read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("source"), F.expr(_KIND).alias("kind"), (F.col("l_returnflag") == "A").alias("is_test"))


def _impact_symbols(spark, sf_dir):
    """Parts as targets in their brand; suppliers as sources in eight modules, in a range of ids of their own."""
    p = R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("module"), F.expr("case when p_size > 33 then 'public' when p_size > 16 then 'internal' else 'private' end").alias("visibility"))
    s = R.read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("symbol_id"), F.concat(F.lit("S"), F.col("s_suppkey") % 8).alias("module"), F.lit("public").alias("visibility"))
    return p.unionByName(s)


_REPORT = f"""{_REFS}, by1 AS (SELECT target, count(DISTINCT source) FILTER (WHERE NOT is_test) AS callers, count(DISTINCT source_module) FILTER (WHERE NOT is_test) AS modules, count(*) FILTER (WHERE is_test) AS tests, max(CASE impact WHEN 'direct-caller' THEN 0.9 WHEN 'type-dependency' THEN 0.7 ELSE 0.4 END) AS kr, ((sum(CAST(round(confidence * 100) AS BIGINT)) * 20000 + count(*)) // (2 * count(*))) / 1e6 AS confidence FROM it GROUP BY 1),
rep AS (SELECT target, callers, modules, tests, confidence, CASE WHEN p_size > 33 THEN 'public' WHEN p_size > 16 THEN 'internal' ELSE 'private' END AS visibility,
round(0.3 * CASE WHEN p_size > 33 THEN 0.9 WHEN p_size > 16 THEN 0.5 ELSE 0.2 END + 0.35 * least(log10(callers + 1) / log10(21), 1) + 0.25 * CASE WHEN modules <= 1 THEN 0 WHEN modules = 2 THEN 0.2 ELSE least(log10(modules), 1) END + 0.1 * kr, 6)::DOUBLE AS score, p_brand FROM by1 JOIN part ON p_partkey = target),
rl AS (SELECT *, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM rep)"""


def _report(spark, sf_dir):
    return impact.impact_report(_refs(spark, sf_dir).withColumn("source", F.col("source") + 10_000_000), _impact_symbols(spark, sf_dir))


@query(f"WITH {_REPORT} SELECT target, callers, modules, tests, confidence, visibility, score, level FROM rl")
def impact_risk(spark, sf_dir):
    return _report(spark, sf_dir)


@query(f"WITH {_REPORT} SELECT p_brand AS module, count(*) AS targets, CASE max(CASE level WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS worst FROM rl GROUP BY 1")
def impact_modules(spark, sf_dir):
    return impact.module_rollup(_report(spark, sf_dir), _impact_symbols(spark, sf_dir))


@query(f"WITH {_REFS} SELECT impact, confidence::DOUBLE AS confidence, count(*) AS n FROM it GROUP BY 1, 2")
def impact_classes(spark, sf_dir):
    kind, conf = impact.classify(F.col("is_test"), F.col("kind"))
    return _refs(spark, sf_dir).groupBy(kind.alias("impact"), conf.alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH f AS (SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN 'protected' END AS m, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = p_partkey) % 3 AS refs, CASE WHEN p_partkey % 4 = 0 THEN '_' || p_name ELSE p_brand END AS name FROM part) SELECT id, CASE WHEN m IS NOT NULL THEN m WHEN refs > 1 THEN 'public' WHEN refs = 1 THEN 'internal' WHEN name LIKE '\\_%' ESCAPE '\\' THEN 'private' WHEN regexp_matches(name, '^[A-Z]') THEN 'public' ELSE 'internal' END AS visibility, CAST(CASE WHEN m IS NOT NULL THEN 0.95 WHEN refs > 1 THEN 0.9 WHEN refs = 1 THEN 0.7 WHEN name LIKE '\\_%' ESCAPE '\\' THEN 0.7 WHEN regexp_matches(name, '^[A-Z]') THEN 0.6 ELSE 0.5 END AS DOUBLE) AS confidence FROM f")
def visibility_ladder(spark, sf_dir):
    p = R.read(spark, sf_dir, "part")
    n = R.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg((F.countDistinct("l_suppkey") % 3).alias("refs"))
    f = p.join(n, F.col("p_partkey") == F.col("k"), "left").select(F.col("p_partkey").alias("id"), F.expr("case when p_size % 10 = 0 then 'protected' end").alias("m"), F.coalesce("refs", F.lit(0)).alias("refs"), F.expr("case when p_partkey % 4 = 0 then concat('_', p_name) else p_brand end").alias("name"))
    seen, conf = impact.visibility_ladder(F.col("m"), F.col("refs"), F.col("name"))
    return f.select("id", seen.alias("visibility"), conf.alias("confidence"))


@query(f"WITH {_REPORT}, u AS (SELECT target, level, score, callers, tests FROM rl) SELECT target, round(least(0.55 * score + 0.2 * least(log10(callers + 1) / 4, 1) + 0.15 * least(tests / 10, 1) + 0.1 * (target % 2), greatest(score, least(log10(callers + 1) / 4, 1), least(tests / 10, 1), target % 2) + 0.03), 6)::DOUBLE AS blended FROM u")
def impact_with_usage(spark, sf_dir):
    r = _report(spark, sf_dir)
    return r.select("target", impact.with_usage(F.col("score"), F.col("callers"), F.col("tests"), F.col("target") % 2 == 1).alias("blended"))


@query(
    "WITH f AS (SELECT c_custkey AS id, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS callers, c_nationkey % 7 = 0 AS decision, c_nationkey > 12 AS public FROM customer) "
    "SELECT id, CASE WHEN callers > 0 THEN 'keep' WHEN decision OR public THEN 'investigate' ELSE 'remove' END AS verdict, "
    "CAST(CASE WHEN callers > 0 THEN 0.9 WHEN decision THEN 0.75 WHEN public THEN 0.6 ELSE 0.7 END AS DOUBLE) AS confidence FROM f"
)
def justify_symbol(spark, sf_dir):
    """Symbols that anyone has ever called are kept: customers as symbols, all their events as calls."""
    from loam.operators.usage import verdict

    n = R.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("callers"))
    p = R.read(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("k"), "left")
    v, c = verdict(F.coalesce("callers", F.lit(0)), F.col("c_nationkey") % 7 == 0, F.col("c_nationkey") > 12)
    return p.select(F.col("c_custkey").alias("id"), v.alias("verdict"), c.alias("confidence"))


# -- modules ---------------------------------------------------------------------------------------------------------------


@query("SELECT src AS source, dst AS target, count(*) AS strength FROM (SELECT DISTINCT a.p_brand AS src, b.p_brand AS dst, x.l_orderkey FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey JOIN part a ON a.p_partkey = x.l_partkey JOIN part b ON b.p_partkey = y.l_partkey) WHERE src <> dst GROUP BY 1, 2")
def module_edges(spark, sf_dir):
    li = R.read(spark, sf_dir, "lineitem").join(R.symbols(spark, sf_dir), F.col("l_partkey") == F.col("symbol_id")).select("l_orderkey", "module").distinct()
    pairs = li.select("l_orderkey", F.col("module").alias("source")).join(li.withColumnRenamed("module", "target"), "l_orderkey")
    return modules.module_edges(pairs.withColumn("kind", F.lit("workspace")))


@query(R.using("symbols") + ", r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY score DESC, symbol_id) AS i FROM symbols) SELECT module, count(*) AS symbols, count(DISTINCT kind) AS kinds, round(sum(score), 4) AS score, string_agg(name, '|' ORDER BY i) FILTER (WHERE i <= 3) AS top_names FROM r GROUP BY 1")
def module_map(spark, sf_dir):
    return modules.module_map(R.symbols(spark, sf_dir))


_PATHS = "'src/' || p_brand || '/' || lower(p_type) || '/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.go' WHEN 1 THEN '.py' WHEN 2 THEN '_test.go' ELSE '.txt' END"


def _paths(spark, sf_dir):
    return R.read(spark, sf_dir, "part").select(F.expr(_PATHS.replace("' || ", "', ").replace(" || '", ", '").replace(" || ", ", ").join(["concat(", ")"]).replace("CASE p_partkey % 4 WHEN", "CASE (p_partkey % 4) WHEN")).alias("path"), "p_size")


@query(f"WITH f AS (SELECT {_PATHS} AS path FROM part), roots AS (SELECT * FROM (VALUES ('src', 'root'), ('src/Brand#11', 'eleven'), ('src/Brand#1', 'one'), ('src/Brand#11/economy', 'eleven-economy')) t(root, module)), h AS (SELECT path, module, length(root) AS n FROM f JOIN roots ON starts_with(path, root || '/') OR path = root) SELECT path, arg_max(module, n) AS module FROM h GROUP BY 1")
def longest_prefix_module(spark, sf_dir):
    roots = spark.createDataFrame([("src", "root"), ("src/Brand#11", "eleven"), ("src/Brand#1", "one"), ("src/Brand#11/economy", "eleven-economy")], "root string, module string")
    return modules.longest_prefix(_paths(spark, sf_dir), roots)


@query(f"WITH f AS (SELECT {_PATHS} AS path FROM part) SELECT CASE WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.py' THEN 'python' ELSE 'unknown' END AS language, regexp_matches(lower(path), '_test\\.|\\.test\\.|/test/|/tests/|_test$|\\.spec\\.') AS is_test, count(*) AS files FROM f GROUP BY 1, 2")
def language_files(spark, sf_dir):
    f = _paths(spark, sf_dir)
    return f.groupBy(modules.language(F.col("path")).alias("language"), scoring.is_test_path(F.col("path")).alias("is_test")).agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH f AS (SELECT {_PATHS} AS path, p_size FROM part) SELECT array_to_string(string_split(path, '/')[1:2], '/') AS module, count(*) AS files, CAST(sum(p_size) AS BIGINT) AS loc FROM f GROUP BY 1")
def module_files_loc(spark, sf_dir):
    f = _paths(spark, sf_dir)
    return f.groupBy(modules.first_segments(F.col("path"), 2).alias("module")).agg(F.count(F.lit(1)).alias("files"), F.sum("p_size").alias("loc"))


@query("WITH i AS (SELECT p_partkey AS id, 'app/x' AS source, CASE p_partkey % 6 WHEN 0 THEN './a' WHEN 1 THEN 'fmt' WHEN 2 THEN 'ws/b' WHEN 3 THEN 'app/c' WHEN 4 THEN 'host.org/d' ELSE 'other' END AS module FROM part) SELECT module, CASE WHEN starts_with(module, '.') THEN 'local-file' WHEN module = 'fmt' THEN 'stdlib' WHEN module = 'ws/b' THEN 'workspace' WHEN module = 'app/c' THEN 'local-module' WHEN contains(split_part(module, '/', 1), '.') THEN 'external' ELSE 'unknown' END AS kind, count(*) AS n FROM i GROUP BY 1, 2")
def import_kinds(spark, sf_dir):
    m = F.expr("case p_partkey % 6 when 0 then './a' when 1 then 'fmt' when 2 then 'ws/b' when 3 then 'app/c' when 4 then 'host.org/d' else 'other' end".replace("p_partkey % 6", "(p_partkey % 6)"))
    i = R.read(spark, sf_dir, "part").select(F.lit("app/x").alias("source"), m.alias("module"))
    return i.groupBy("module", modules.classify_import(F.col("source"), F.col("module"), ["fmt", "os"], ["ws"]).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand AS language, count(*) AS files, CAST(sum(p_size) AS BIGINT) AS symbols, CAST(sum(p_partkey % 100) AS BIGINT) AS refs, round(sum(p_partkey % 100) / sum(p_size), 6) AS ratio, CASE WHEN sum(p_partkey % 100) / sum(p_size) >= 3 THEN 'full' WHEN sum(p_partkey % 100) / sum(p_size) >= 1 THEN 'partial' ELSE 'basic' END AS level FROM part GROUP BY 1")
def language_quality(spark, sf_dir):
    p = R.read(spark, sf_dir, "part").select(F.col("p_brand").alias("language"), F.col("p_size").alias("symbols"), (F.col("p_partkey") % 100).alias("refs"))
    return modules.language_quality(p)


@query("SELECT p_partkey AS id, CASE WHEN (CASE WHEN p_partkey >= 1000 THEN 3 WHEN p_partkey >= 100 THEN 2 WHEN p_partkey >= 10 THEN 1 ELSE 0 END + CASE WHEN p_size >= 20 THEN 2 WHEN p_size >= 10 THEN 1 ELSE 0 END) >= 4 THEN 'high' WHEN (CASE WHEN p_partkey >= 1000 THEN 3 WHEN p_partkey >= 100 THEN 2 WHEN p_partkey >= 10 THEN 1 ELSE 0 END + CASE WHEN p_size >= 20 THEN 2 WHEN p_size >= 10 THEN 1 ELSE 0 END) >= 2 THEN 'medium' ELSE 'low' END AS importance FROM part")
def export_importance(spark, sf_dir):
    return R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), modules.importance(F.col("p_partkey"), F.col("p_size")).alias("importance"))


@query("SELECT p_partkey AS id, 'manifest' AS origin FROM part WHERE p_size < 10")
def module_discovery(spark, sf_dir):
    """Modules of the first way of finding them that finds any: none is declared, some have a manifest."""
    p = R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    kind = lambda cond, name: p.where(cond).select("id", F.lit(name).alias("origin"))
    return modules.prefer_first([kind("p_size > 1000", "declared"), kind("p_size < 10", "manifest"), kind("p_size < 40", "convention")], "id").select("id", "origin")
