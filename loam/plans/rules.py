"""Queries over rule ladders, invalidation and graph building."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions import scoring
from loam.operators import delta, docs, graph
from loam.plans.catalog import query
from loam.sources import relations as R


@query("SELECT p_partkey AS id, CASE WHEN p_size / 50 >= 0.9 THEN 'high' WHEN p_size / 50 >= 0.8 THEN 'good' WHEN p_size / 50 >= 0.7 THEN 'fair' WHEN p_size / 50 >= 0.4 THEN 'low' ELSE 'none' END AS tier FROM part")
def confidence_tiers(spark, sf_dir):
    p = R.read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), scoring.ladder(F.col("p_size") / 50, [(0.9, "high"), (0.8, "good"), (0.7, "fair"), (0.4, "low")], "none").alias("tier"))


@query("WITH c AS (SELECT user_id, avg((event_type = 'click')::INT) AS cov, count(*) AS n FROM events GROUP BY 1) SELECT user_id, round(cov, 6) AS cov, cov >= 0.15 AND n >= 20 AS usable, cov >= 0.2 AS dead_code_allowed FROM c")
def coverage_gates(spark, sf_dir):
    c = R.calls(spark, sf_dir).groupBy(F.col("service").alias("user_id")).agg(F.avg(F.when(F.col("function") == "click", 1.0).otherwise(0.0)).alias("cov"), F.count(F.lit(1)).alias("n"))
    return c.select("user_id", F.round("cov", 6).alias("cov"), ((F.col("cov") >= 0.15) & (F.col("n") >= 20)).alias("usable"), (F.col("cov") >= 0.2).alias("dead_code_allowed"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' WHEN 3 THEN 'R' WHEN 4 THEN 'A' ELSE 'M' END AS op FROM orders")
def change_status_codes(spark, sf_dir):
    s = F.expr("case (o_orderkey % 6) when 0 then 'A' when 1 then 'M' when 2 then 'D' when 3 then 'R100' when 4 then 'C75' else 'T' end")
    return R.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), delta.change_code(s).alias("op"))


_DEPS = "dep AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem UNION SELECT DISTINCT l_partkey + 1000000, o_custkey + 100000000 FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION SELECT DISTINCT o_custkey + 100000000, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query(f"WITH RECURSIVE {_DEPS}, w(id, depth) AS (SELECT 3::BIGINT, 0 UNION SELECT dst, depth + 1 FROM w JOIN dep ON src = id WHERE depth < 3) SELECT id, min(depth) AS depth FROM w GROUP BY 1")
def invalidation_closure(spark, sf_dir):
    """Files to rescan after a change: dependents within three steps, each at its least depth."""
    li = R.read(spark, sf_dir, "lineitem").join(R.read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b, c = F.col("l_suppkey"), F.col("l_partkey") + 1_000_000, F.col("o_custkey") + 100_000_000
    ways = F.array(*[F.struct(x.alias("src"), y.alias("dst")) for x, y in ((a, b), (b, c), (c, a))])
    return graph.reach(li.select(F.explode(ways).alias("w")).select("w.src", "w.dst"), spark.createDataFrame([(3,)], "id long"), 3)


@query(
    """WITH o AS (SELECT user_id AS doc, event_id AS pos, CASE WHEN event_type = 'signup' THEN event_id END AS def, event_type FROM events),
c AS (SELECT doc, pos, event_type, last_value(def IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS container FROM o)
SELECT container AS src, event_type AS dst, count(*) AS n, CAST(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.8 END AS DOUBLE) AS weight FROM c WHERE container IS NOT NULL AND event_type <> 'signup' GROUP BY 1, 2"""
)
def container_graph(spark, sf_dir):
    """Edges from the definition last seen in a document to what is referenced after it."""
    c = R.calls(spark, sf_dir)
    w = Window.partitionBy("service").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    held = c.withColumn("src", F.last(F.when(F.col("function") == "signup", F.col("event_id")), ignorenulls=True).over(w))
    kept = held.where("src is not null and function <> 'signup'")
    return kept.groupBy("src", F.col("function").alias("dst")).agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.when(F.col("dst") == "click", 1.0).otherwise(0.8))


@query("WITH s AS (SELECT l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY 1) SELECT kind, n, CAST(CASE kind WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.9 ELSE 0.8 END AS DOUBLE) AS weight FROM s")
def edge_kinds(spark, sf_dir):
    k = F.when(F.col("kind") == "A", 1.0).when(F.col("kind") == "N", 0.9).otherwise(0.8)
    return R.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count(F.lit(1)).alias("n")).withColumn("weight", k)


@query("WITH p AS (SELECT * FROM (VALUES ('PROMO', 'SMALL'), ('SMALL', 'LARGE'), ('NONE', 'PROMO')) t(source, target)), k AS (SELECT DISTINCT p_type AS t FROM part) SELECT source, target FROM p WHERE source IN (SELECT t FROM k) AND target IN (SELECT t FROM k)")
def integration_templates(spark, sf_dir):
    """Template pairs both of whose ends exist."""
    p = spark.createDataFrame([("PROMO", "SMALL"), ("SMALL", "LARGE"), ("NONE", "PROMO")], "source string, target string")
    k = R.read(spark, sf_dir, "part").select(F.col("p_type").alias("t")).distinct()
    return p.join(k, F.col("source") == F.col("t"), "left_semi").join(k, F.col("target") == F.col("t"), "left_semi")


@query("WITH r AS (SELECT p_brand AS module, p_name AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part) SELECT module, string_agg(name, ', ' ORDER BY i) FILTER (WHERE i <= 5) AS summary, count(*) FILTER (WHERE i <= 10) AS listed FROM r GROUP BY 1")
def capability_summary(spark, sf_dir):
    w = Window.partitionBy("module").orderBy("symbol_id")
    r = R.symbols(spark, sf_dir).withColumn("i", F.row_number().over(w)).where("i <= 10")
    five = F.array_sort(F.collect_list(F.when(F.col("i") <= 5, F.struct("i", "name"))))
    return r.groupBy("module").agg(F.array_join(F.transform(five, lambda x: x["name"]), ", ").alias("summary"), F.count(F.lit(1)).alias("listed"))


@query("WITH s AS (SELECT p_partkey AS symbol_id, replace(p_name, ' ', '.') AS name FROM part) SELECT name AS ending, array_to_string(list_sort(list(symbol_id))[1:5], ',') AS suggestions FROM s GROUP BY 1")
def suffix_suggestions(spark, sf_dir):
    """Up to five symbols for each ending of two segments."""
    s = R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.replace(F.col("p_name"), F.lit(" "), F.lit(".")).alias("name"))
    ids = F.slice(F.array_sort(F.collect_list("symbol_id")), 1, 5)
    return docs.suffix_index(s).groupBy(F.col("suffix").alias("ending")).agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("suggestions"))


@query("WITH s AS (SELECT s_suppkey AS id, s_suppkey % 40 AS b FROM supplier) SELECT id, CASE WHEN b = 0 THEN 'fresh' WHEN b <= 5 THEN 'near' WHEN b <= 20 THEN 'behind' ELSE 'stale' END AS freshness, CAST(CASE WHEN b = 0 THEN 1.0 WHEN b <= 5 THEN 0.9 WHEN b <= 20 THEN 0.6 ELSE 0.3 END AS DOUBLE) AS score FROM s")
def index_freshness(spark, sf_dir):
    b = F.col("s_suppkey") % 40
    step = lambda a, c, d, e: F.when(b == 0, a).when(b <= 5, c).when(b <= 20, d).otherwise(e)
    return R.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), step("fresh", "near", "behind", "stale").alias("freshness"), step(1.0, 0.9, 0.6, 0.3).alias("score"))


@query("SELECT p_partkey AS id, CASE WHEN p_size > 25 AND p_retailprice > 950 THEN 'full' WHEN p_size > 25 OR p_retailprice > 950 THEN 'partial' ELSE 'none' END AS context FROM part")
def type_context(spark, sf_dir):
    a, b = F.col("p_size") > 25, F.col("p_retailprice") > 950
    return R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(a & b, "full").when(a | b, "partial").otherwise("none").alias("context"))


@query("WITH h AS (SELECT doc_id AS id, md5(coalesce(text, '')) AS h FROM documents WHERE doc_id % 3 > 0), n AS (SELECT doc_id AS id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE coalesce(text, '') END) AS h FROM documents) SELECT id FROM n WHERE (id, h) NOT IN (SELECT id, h FROM h)")
def hash_skip_index(spark, sf_dir):
    """Documents whose hash is not indexed yet."""
    d = R.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    old = d.where("id % 3 > 0").select("id", F.md5("t").alias("h"))
    new = d.select("id", F.md5(F.when(F.col("id") % 5 == 0, F.concat("t", F.lit("!"))).otherwise(F.col("t"))).alias("h"))
    return new.join(old, ["id", "h"], "left_anti").select("id")


@query("WITH b AS (SELECT vec_id, label, embedding FROM embeddings), q AS (SELECT label, count(*) AS n, round(avg(embedding[1]), 5) AS first_mean FROM b GROUP BY 1) SELECT label, n, first_mean FROM q")
def embedding_labels(spark, sf_dir):
    e = R.read(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.get("embedding", F.lit(0)).cast("double")), 5).alias("first_mean"))
