"""Queries over listings, scalar expressions and composed reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import scoring, text
from loam.operators import churn, coupling, graph, listing, modules, ownership
from loam.plans.catalog import query
from loam.sources import relations as R


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey = 42")
def symbol_lookup(spark, sf_dir):
    return listing.point(R.read(spark, sf_dir, "part"), "p_partkey", 42).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("SELECT p_partkey AS id, p_brand AS module FROM part WHERE p_type = 'PROMO' AND p_size > 10 ORDER BY p_brand, p_partkey LIMIT 40 OFFSET 5")
def identity_listing(spark, sf_dir):
    p = R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("module"), "p_type", "p_size")
    return listing.listing(p, [F.col("p_type") == "PROMO", None, F.col("p_size") > 10], ["module", "id"], 40, 5).select("id", "module")


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY'")
def exclusive_filter(spark, sf_dir):
    c = R.read(spark, sf_dir, "customer")
    return listing.first_condition(c, [None, F.col("c_mktsegment") == "MACHINERY", F.col("c_acctbal") > 0]).select(F.col("c_custkey").alias("id"))


@query("SELECT o_orderkey AS id, o_orderpriority AS kind FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 50")
def custom_rank_order(spark, sf_dir):
    o = R.read(spark, sf_dir, "orders")
    return o.orderBy(listing.ranked(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]), F.desc("o_totalprice"), "o_orderkey").limit(50).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"))


@query("SELECT l_partkey AS symbol, l_orderkey AS caller, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS nth FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) QUALIFY nth <= 3")
def first_callers(spark, sf_dir):
    li = R.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("caller")).distinct()
    return listing.first_n(li, "symbol", ["caller"], 3).withColumn("nth", F.col("nth").cast("long"))


@query("WITH p AS (SELECT DISTINCT 'a/' || p_brand || '/' || p_type AS path FROM part), r AS (SELECT * FROM (VALUES ('a', 1), ('a', 2), ('a/Brand#1', 3), ('a/Brand#1', 4), ('a/Brand#2/PROMO', 5)) t(module, record)), b AS (SELECT path, arg_max(module, length(module)) AS module FROM p JOIN r ON path = module OR starts_with(path, module || '/') GROUP BY 1) SELECT path, module, record FROM b JOIN r USING (module) QUALIFY row_number() OVER (PARTITION BY path ORDER BY record DESC) <= 1")
def decisions_by_ancestor(spark, sf_dir):
    p = R.read(spark, sf_dir, "part").select(F.concat(F.lit("a/"), "p_brand", F.lit("/"), "p_type").alias("path")).distinct()
    r = spark.createDataFrame([("a", 1), ("a", 2), ("a/Brand#1", 3), ("a/Brand#1", 4), ("a/Brand#2/PROMO", 5)], "module string, record int")
    return listing.nearest_ancestor(p, r, 1)


@query("WITH b AS (SELECT l_suppkey AS edge, max(l_discount * 10) AS m, avg(l_discount * 10) AS a, arg_max(l_shipinstruct, (s, l_shipinstruct)) AS reason FROM (SELECT l_suppkey, l_discount, l_discount * 10 AS s, l_returnflag || l_linestatus AS l_shipinstruct FROM lineitem) GROUP BY 1) SELECT edge, round(CASE WHEN m >= 0.95 THEN m ELSE a END, 6) AS score, reason FROM b")
def edge_confidence(spark, sf_dir):
    li = R.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("edge"), (F.col("l_discount") * 10).alias("s"), F.concat("l_returnflag", "l_linestatus").alias("why"))
    return listing.max_or_mean(li, "edge", "s", "why", 0.95)


@query("WITH q AS (SELECT o_orderkey AS id, o_orderdate AS enqueued, o_custkey % 3 AS depth, o_totalprice AS cost FROM orders WHERE o_orderstatus = 'P' ORDER BY 2, 3, 1 LIMIT 200), s AS (SELECT id, sum(cost) OVER (ORDER BY enqueued, depth, id) AS spent FROM q) SELECT id, round(spent, 2) AS spent FROM s WHERE spent <= 5000000")
def budgeted_queue(spark, sf_dir):
    q = R.read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("enqueued"), (F.col("o_custkey") % 3).alias("depth"), F.col("o_totalprice").alias("cost"))
    return listing.work_queue(q, 200, "cost", 5_000_000).select("id", F.round("spent", 2).alias("spent"))


@query("WITH s AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey <= 2), m AS (SELECT DISTINCT l_partkey + 1000000 AS id FROM lineitem WHERE l_suppkey <= 2), u AS (SELECT id, min(p) AS p FROM (SELECT id, 0 AS p FROM s UNION ALL SELECT id, 1 FROM m) GROUP BY 1) SELECT id, p FROM u ORDER BY p, id LIMIT 30")
def seed_expansion(spark, sf_dir):
    s = R.read(spark, sf_dir, "supplier").where("s_suppkey <= 2").select(F.col("s_suppkey").alias("id"))
    m = R.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), (F.col("l_partkey") + 1_000_000).alias("id"))
    return listing.seed_expansion(s, m, 30)


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE l_returnflag IS NULL OR trim(l_returnflag) = '') AS incomplete, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeated FROM lineitem")
def data_quality(spark, sf_dir):
    return listing.validate(R.read(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_orderkey", "l_linenumber"])


@query("SELECT count(*) AS matched FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_acctbal > 0")
def filtered_count(spark, sf_dir):
    return R.read(spark, sf_dir, "customer").where("c_mktsegment in ('BUILDING', 'FURNITURE') and c_acctbal > 0").agg(F.count(F.lit(1)).alias("matched"))


_CAMEL = "upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || CASE WHEN p_partkey % 2 = 0 THEN 'Handler' ELSE '' END"


@query(f"SELECT p_partkey AS id, {_CAMEL} AS name, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS concept FROM part")
def camel_concepts(spark, sf_dir):
    p = R.read(spark, sf_dir, "part")
    name = F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.when(F.col("p_partkey") % 2 == 0, "Handler").otherwise(""))
    return p.select(F.col("p_partkey").alias("id"), name.alias("name")).withColumn("concept", text.concept(F.col("name")))


@query("SELECT p_partkey AS id, 'src/' || p_brand || '/' || p_type AS path, substr(sha256(p_name), 1, 8) AS hash FROM part")
def paths_normalised(spark, sf_dir):
    p = R.read(spark, sf_dir, "part")
    messy = F.concat(F.lit(".\\src//"), "p_brand", F.lit("/./"), "p_type", F.lit("/"))
    return p.select(F.col("p_partkey").alias("id"), text.normalise_path(messy).alias("path"), text.short_hash(F.col("p_name")).alias("hash"))


@query("WITH m AS (SELECT o_orderkey AS id, 'fix #' || (o_custkey % 50) || ' and AB-' || (o_orderkey % 9) || ', see #' || (o_custkey % 50) AS msg FROM orders) SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(msg, '(#\\d+|[A-Z]{2,}-\\d+)', 1))), ',') AS issues FROM m")
def issue_references(spark, sf_dir):
    o = R.read(spark, sf_dir, "orders")
    msg = F.concat(F.lit("fix #"), F.col("o_custkey") % 50, F.lit(" and AB-"), F.col("o_orderkey") % 9, F.lit(", see #"), F.col("o_custkey") % 50)
    return o.select(F.col("o_orderkey").alias("id"), F.array_join(text.issue_keys(msg), ",").alias("issues"))


@query("SELECT item_id AS id, CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS BIGINT) AS n FROM benchmark")
def token_counts(spark, sf_dir):
    return R.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), text.occurrences_of(F.col("text"), "th").alias("n"))


@query("SELECT p_partkey AS id, round(greatest(0, (CASE WHEN p_type = 'PROMO' THEN 100 WHEN p_type = 'STANDARD' THEN 80 WHEN p_type = 'LARGE' THEN 60 WHEN p_type = 'MEDIUM' THEN 40 ELSE 20 END - 5 * (p_size % 12 - 1)) * 0.5), 6)::DOUBLE AS score FROM part")
def path_scores(spark, sf_dir):
    p = R.read(spark, sf_dir, "part")
    kind = F.expr("case p_type when 'PROMO' then 'api' when 'STANDARD' then 'cli' when 'LARGE' then 'job' when 'MEDIUM' then 'event' else 'x' end")
    return p.select(F.col("p_partkey").alias("id"), text.path_score(kind, F.col("p_size") % 12, F.lit(0.5)).alias("score"))


@query("SELECT p_partkey AS id, round(0.5 * (p_size / (p_size + 10)) + 0.2 * ((p_partkey % 5) / ((p_partkey % 5) + 3)) + 0.3 * ((p_partkey % 90) / ((p_partkey % 90) + 30)), 6) AS churn FROM part")
def saturating_scores(spark, sf_dir):
    p = R.read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.round(scoring.churn_score(F.col("p_size"), F.col("p_partkey") % 5, F.col("p_partkey") % 90), 6).alias("churn"))


@query("SELECT event_type AS function, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 7 DAY GROUP BY 1")
def relative_period(spark, sf_dir):
    return R.calls(spark, sf_dir).where(F.col("ts") >= text.since_days(R.USAGE_AS_OF, "7d")).groupBy("function").agg(F.count(F.lit(1)).alias("n"))


_BLAME = R.using("blame")


@query(_BLAME + ", m AS (SELECT file, count(DISTINCT author) AS authors, 2001 * 12 + 12 - year(max(ts)) * 12 - month(max(ts)) AS months FROM blame GROUP BY 1) SELECT file, array_to_string(list_filter([CASE WHEN file % 10 = 0 AND months > 3 THEN 'temporary' END, CASE WHEN authors <= 1 THEN 'bus-factor' END, CASE WHEN file % 7 >= 3 THEN 'coupled' END, CASE WHEN months >= 12 THEN 'stale' END], lambda x: x IS NOT NULL), ',') AS warnings FROM m")
def origin_warnings(spark, sf_dir):
    b = R.blame(spark, sf_dir)
    m = ownership.staleness_months(b, R.HISTORY_AS_OF).join(b.groupBy("file").agg(F.countDistinct("author").alias("authors")), "file")
    return m.select("file", F.array_join(text.warnings(F.col("months"), F.col("authors"), F.col("file") % 7, F.col("file") % 10 == 0), ",").alias("warnings"))


# -- composed reports ------------------------------------------------------------------------------------------------------


@query(
    R.using("commit_files", "symbols")
    + """, ch AS (SELECT path, count(DISTINCT commit_id) AS changes, count(DISTINCT author) AS authors FROM commit_files GROUP BY 1), cr AS (SELECT path, count(DISTINCT l_suppkey) AS callers FROM (SELECT l_partkey AS path, l_suppkey FROM lineitem) GROUP BY 1)
SELECT symbol_id, name, module, coalesce(changes, 0) AS changes, coalesce(authors, 0) AS authors, coalesce(callers, 0) AS callers, coalesce(callers, 0) = 0 AS unused FROM symbols LEFT JOIN ch ON ch.path = symbol_id LEFT JOIN cr ON cr.path = symbol_id"""
)
def symbol_dossier(spark, sf_dir):
    ch = churn.file_churn(R.commit_files(spark, sf_dir)).select(F.col("path").alias("symbol_id"), "changes", "authors")
    cr = graph.degrees(R.edges(spark, sf_dir)).where("incoming > 0").select((F.col("id") - 1_000_000).alias("symbol_id"), F.col("incoming").alias("callers"))
    s = R.symbols(spark, sf_dir).select("symbol_id", "name", "module").join(ch, "symbol_id", "left").join(cr, "symbol_id", "left")
    return s.na.fill(0, ["changes", "authors", "callers"]).withColumn("unused", F.col("callers") == 0)


@query(
    R.using("symbols", "commit_files")
    + """, e AS (SELECT DISTINCT l_suppkey, p_brand AS module FROM lineitem JOIN part ON p_partkey = l_partkey), i AS (SELECT module, count(*) AS incoming FROM e GROUP BY 1), c AS (SELECT p_brand AS module, count(DISTINCT commit_id) AS changes FROM commit_files JOIN part ON p_partkey = path GROUP BY 1), m AS (SELECT module, count(*) AS symbols, count(DISTINCT kind) AS kinds FROM symbols GROUP BY 1)
SELECT m.module, symbols, kinds, coalesce(incoming, 0) AS incoming, coalesce(changes, 0) AS changes FROM m LEFT JOIN i USING (module) LEFT JOIN c USING (module) ORDER BY changes DESC, m.module LIMIT 10"""
)
def architecture_report(spark, sf_dir):
    s = R.symbols(spark, sf_dir)
    of = s.select(F.col("symbol_id").alias("path"), "module")
    m = modules.module_map(s).select("module", "symbols", "kinds")
    i = R.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), "l_suppkey").join(of, "path").groupBy("module").agg(F.countDistinct("l_suppkey").alias("incoming"))
    c = R.commit_files(spark, sf_dir).join(of, "path").groupBy("module").agg(F.countDistinct("commit_id").alias("changes"))
    out = m.join(i, "module", "left").join(c, "module", "left").na.fill(0, ["incoming", "changes"])
    return out.orderBy(F.desc("changes"), "module").limit(10)


@query(
    R.using("commit_files")
    + ", d AS (SELECT * FROM commit_files WHERE ts >= TIMESTAMP '2001-07-01') SELECT p_brand AS module, count(DISTINCT path) AS files, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS languages FROM d JOIN part ON p_partkey = path GROUP BY 1"
)
def diff_rollup(spark, sf_dir):
    d = R.commit_files(spark, sf_dir).where("ts >= timestamp '2001-07-01'")
    s = R.symbols(spark, sf_dir).select(F.col("symbol_id").alias("path"), "module", "kind")
    return d.join(s, "path").groupBy("module").agg(F.countDistinct("path").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("languages"))


@query(
    R.using("commit_files")
    + ", k AS (SELECT DISTINCT commit_id, path FROM commit_files), p AS (SELECT a.path, count(*) AS pairs, count(DISTINCT b.path) AS partners FROM k a JOIN k b ON a.commit_id = b.commit_id AND a.path <> b.path GROUP BY 1) SELECT path, partners, CAST(pairs AS BIGINT) AS together FROM p"
)
def coupling_degree(spark, sf_dir):
    return coupling.co_changes(R.commit_files(spark, sf_dir)).groupBy("path").agg(F.count(F.lit(1)).alias("partners"), F.sum("together").alias("together"))


@query("SELECT c_custkey AS owner, CASE WHEN c_custkey % 4 = 0 THEN 'team' WHEN c_custkey % 4 = 1 THEN 'user' WHEN c_custkey % 4 = 2 THEN 'email' ELSE 'unknown' END AS kind, 'codeowners' AS source FROM customer UNION ALL SELECT DISTINCT o_custkey, 'user', 'blame' FROM orders")
def owner_sources_union(spark, sf_dir):
    c = R.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"))
    name = F.expr("case c_custkey when 0 then '@o/t' when 1 then '@u' when 2 then 'a@b' else 'x' end".replace("case c_custkey", "case (owner % 4)"))
    b = R.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner")).distinct()
    return c.select("owner", scoring.owner_type(name).alias("kind"), F.lit("codeowners").alias("source")).unionByName(b.select("owner", F.lit("user").alias("kind"), F.lit("blame").alias("source")))
