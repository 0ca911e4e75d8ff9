"""Queries over search, graphs and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.scoring import instability
from loam.operators import graph, intervals, search
from loam.plans.catalog import query
from loam.sources import relations as R
from loam.sources import writers

_TOK = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
_BM25 = f"""t AS (SELECT doc_id, {_TOK} AS ts FROM documents), z AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM t),
p AS (SELECT doc_id, len(ts) AS length, unnest(ts) AS term FROM t), q AS (SELECT term, doc_id, length, count(*) AS tf FROM p WHERE term IN ('license', 'the', 'worthless') GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM q GROUP BY 1), bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM q JOIN df USING (term), z GROUP BY 1)"""


def _bm25(spark, sf_dir):
    d = R.read(spark, sf_dir, "documents")
    terms = ["license", "the", "worthless"]
    at, size = writers.search_index(d, "doc_id", "text")
    return search.bm25(writers.lookup_postings(spark, at, terms), size, "doc_id", terms)


@query(f"WITH {_BM25} SELECT doc_id, round(score, 5) AS score FROM bm ORDER BY round(score, 5) DESC, doc_id LIMIT 50")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir).withColumn("score", F.round("score", 5)).orderBy(F.desc("score"), "doc_id").limit(50)


@query(f"WITH t AS (SELECT item_id, {_TOK} AS ts FROM benchmark), p AS (SELECT item_id, len(ts) AS length, unnest(ts) AS term FROM t) SELECT term, item_id, length, count(*) AS tf FROM p GROUP BY 1, 2, 3")
def search_postings(spark, sf_dir):
    return search.postings(R.read(spark, sf_dir, "benchmark"), "item_id", "text")


@query(f"WITH t AS (SELECT item_id, {_TOK} AS ts FROM benchmark) SELECT item_id FROM t WHERE list_contains(ts, 'the') AND list_contains(ts, 'of')")
def fulltext_match(spark, sf_dir):
    b = R.read(spark, sf_dir, "benchmark").select("item_id", search.tokens(F.col("text")).alias("ts"))
    return b.where(F.array_contains("ts", "the") & F.array_contains("ts", "of")).select("item_id")


_TIER = "CASE WHEN lower(name) = 'red' THEN 1 WHEN starts_with(lower(name), 'red') THEN 2 WHEN contains(lower(name), 'red') THEN 3 END"


@query(R.using("symbols") + f"SELECT symbol_id, name, {_TIER} AS tier, CAST(CASE {_TIER} WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 ELSE 0.5 END AS DOUBLE) AS rank FROM symbols WHERE {_TIER} IS NOT NULL ORDER BY tier, name, symbol_id LIMIT 40")
def search_exact_prefix_substring(spark, sf_dir):
    return search.tiers(R.symbols(spark, sf_dir), "red", 40).select("symbol_id", "name", "tier", "rank")


_VIS = "CASE WHEN line > 33 THEN 'public' WHEN line > 16 THEN 'internal' ELSE 'private' END"
_KIND = "CASE WHEN kind LIKE 'PROMO%' THEN 'class' WHEN kind LIKE 'STANDARD%' THEN 'function' WHEN kind LIKE 'SMALL%' THEN 'method' ELSE 'other' END"
_LEX = f"(CASE WHEN lower(name) = 'red' THEN 100 WHEN starts_with(lower(name), 'red') THEN 50 WHEN contains(lower(name), 'red') THEN 25 ELSE 10 END + CASE {_VIS} WHEN 'public' THEN 30 WHEN 'internal' THEN 20 ELSE 10 END + CASE {_KIND} WHEN 'class' THEN 25 WHEN 'function' THEN 15 WHEN 'method' THEN 10 ELSE 5 END)"


def _ranked(spark, sf_dir):
    s = R.symbols(spark, sf_dir)
    return s.withColumn("lex", search.lexical(F.col("name"), "red", F.expr(_VIS), F.expr(_KIND)))


@query(R.using("symbols") + f"SELECT symbol_id, CAST({_LEX} AS INT) AS lex FROM symbols ORDER BY lex DESC, symbol_id LIMIT 60")
def lexical_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).select("symbol_id", "lex").orderBy(F.desc("lex"), "symbol_id").limit(60)


_NORM = "CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"


@query(R.using("symbols") + f", x AS (SELECT symbol_id, {_LEX} AS lex, score, line FROM symbols) SELECT symbol_id, round(0.5 * {_NORM.format(c='lex')} + 0.3 * {_NORM.format(c='score')} + 0.2 * {_NORM.format(c='line')}, 6) AS fused FROM x")
def minmax_fusion(spark, sf_dir):
    x = _ranked(spark, sf_dir).select("symbol_id", "lex", "score", "line")
    return search.fuse(x, {"lex": 0.5, "score": 0.3, "line": 0.2}).select("symbol_id", "fused")


@query(R.using("symbols") + f", x AS (SELECT symbol_id, {_LEX} AS lex, line / 50 AS g FROM symbols ORDER BY lex DESC, symbol_id LIMIT 30) SELECT symbol_id, row_number() OVER (ORDER BY lex DESC, symbol_id) AS position, round(0.6 / row_number() OVER (ORDER BY lex DESC, symbol_id) + 0.4 * g, 6) AS final FROM x")
def position_rerank(spark, sf_dir):
    x = _ranked(spark, sf_dir).select("symbol_id", "lex", (F.col("line") / 50).alias("g")).orderBy(F.desc("lex"), "symbol_id").limit(30)
    return search.rerank(x, [F.desc("lex"), "symbol_id"], "g").select("symbol_id", F.col("position").cast("long").alias("position"), "final")


_EVAL = "res AS (SELECT p_brand AS c, p_partkey AS item, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part), ex AS (SELECT p_brand AS c, min(p_partkey) AS item FROM part GROUP BY 1)"


@query(f"WITH {_EVAL}, h AS (SELECT ex.c, min(rank) AS rank FROM ex LEFT JOIN res ON res.c = ex.c AND res.item = ex.item AND rank <= 20 GROUP BY 1) SELECT count(*) AS cases, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) * 100, 4) AS recall, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM h")
def eval_recall_mrr(spark, sf_dir):
    from pyspark.sql import Window

    p = R.read(spark, sf_dir, "part").select(F.col("p_brand").alias("case"), F.col("p_partkey").alias("item"), "p_retailprice")
    res = p.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy(F.desc("p_retailprice"), "item"))).where("rank <= 20")
    return search.evaluate(res, p.groupBy("case").agg(F.min("item").alias("item")), 10)


@query("SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'prom')")
def substring_fallback(spark, sf_dir):
    return R.read(spark, sf_dir, "part").where(F.col("p_name").ilike("%ring%") | F.col("p_type").ilike("%prom%")).select(F.col("p_partkey").alias("id"))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'a') AND p_size IN (1, 2, 3, 5, 8) AND (starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#2')) AND NOT contains(lower(p_type), 'steel') ORDER BY p_partkey LIMIT 100")
def symbol_predicate_scan(spark, sf_dir):
    p = R.read(spark, sf_dir, "part")
    keep = F.lower("p_name").contains("a") & F.col("p_size").isin(1, 2, 3, 5, 8) & (F.col("p_brand").startswith("Brand#1") | F.col("p_brand").startswith("Brand#2")) & ~F.lower("p_type").contains("steel")
    return p.where(keep).orderBy("p_partkey").limit(100).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


# -- graphs ------------------------------------------------------------------------------------------------------------

_EDGES = R.using("edges").replace("WITH ", "WITH RECURSIVE ", 1)


@query(R.using("edges") + ", a AS (SELECT src AS id, count(*) AS o FROM edges GROUP BY 1), b AS (SELECT dst AS id, count(*) AS i FROM edges GROUP BY 1) SELECT coalesce(a.id, b.id) AS id, coalesce(i, 0) AS incoming, coalesce(o, 0) AS outgoing FROM a FULL JOIN b ON a.id = b.id")
def degree_counts(spark, sf_dir):
    return graph.degrees(R.kept(spark, sf_dir, R.edges))


@query(R.using("edges") + ", a AS (SELECT src AS id, count(*) AS o FROM edges GROUP BY 1), b AS (SELECT dst AS id, count(*) AS i FROM edges GROUP BY 1) SELECT coalesce(a.id, b.id) AS id, CAST(coalesce(o, 0) / nullif(coalesce(i, 0) + coalesce(o, 0), 0) AS DOUBLE) AS instability FROM a FULL JOIN b ON a.id = b.id")
def instability_ratio(spark, sf_dir):
    d = graph.degrees(R.kept(spark, sf_dir, R.edges))
    return d.select("id", instability(F.col("incoming"), F.col("outgoing")).alias("instability"))


_BOTH = "both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


@query(_EDGES + f", {_BOTH}, w(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM w JOIN both_ways ON src = id WHERE depth < 2) SELECT id, min(depth) AS depth FROM w GROUP BY 1")
def bfs_closure(spark, sf_dir):
    return graph.reach(R.kept(spark, sf_dir, R.edges), spark.createDataFrame([(1,)], "id long"), 2, both=True)


_FLOW = "WITH RECURSIVE " + R.CTE["flow"]
_SIDE = "{r}0 AS (SELECT 7::BIGINT AS id, 0 AS depth, 0::BIGINT AS weight), " + ", ".join(f"{{r}}{d} AS (SELECT flow.{{to}} AS id, {d} AS depth, CAST(sum(n) AS BIGINT) AS weight FROM {{r}}{d - 1} w JOIN flow ON flow.{{at}} = w.id WHERE flow.{{to}} NOT IN ({' UNION '.join(f'SELECT id FROM {{r}}{k}' for k in range(d))}) GROUP BY 1)" for d in (1, 2, 3))
_ROLES = _SIDE.format(r="callee", at="src", to="dst") + ", " + _SIDE.format(r="caller", at="dst", to="src")


@query(R.using("flow") + f", {_ROLES} SELECT id, 'root' AS role, depth, weight FROM callee0 " + " ".join(f"UNION ALL SELECT id, '{r}', depth, weight FROM {r}{d}" for r in ("callee", "caller") for d in (1, 2, 3)))
def call_graph_roles(spark, sf_dir):
    """Callers and callees of one symbol, three steps both ways."""
    return graph.call_graph(R.kept(spark, sf_dir, R.flow).withColumnRenamed("n", "weight"), 7, 3)


@query(_FLOW + ", w(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM w JOIN flow ON src = id WHERE depth < 2) SELECT id, min(depth) AS depth FROM w GROUP BY 1")
def call_graph_depth2(spark, sf_dir):
    return graph.reach(R.kept(spark, sf_dir, R.flow), spark.createDataFrame([(1,)], "id long"), 2)


@query(
    R.using("flow")
    + ", p1 AS (SELECT src AS source, dst AS id, [src, dst] AS path FROM flow WHERE src IN (3, 5, 8)), p2 AS (SELECT source, flow.dst AS id, min(list_append(path, flow.dst)) AS path FROM p1 JOIN flow ON flow.src = id WHERE flow.dst <> source AND (source, flow.dst) NOT IN (SELECT source, id FROM p1) GROUP BY 1, 2), every AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2) SELECT source, id AS target, array_to_string(path, '>') AS path, len(path)::INT - 1 AS hops FROM every WHERE id IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(path), path) <= 2"
)
def paths_to_targets(spark, sf_dir):
    """From several entry points, the two shortest ways of at most two calls to each symbol of one kind."""
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    targets = R.read(spark, sf_dir, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("id"))
    found = graph.paths_between(R.kept(spark, sf_dir, R.flow), ids(3, 5, 8), targets, 2, 2)
    return found.select("source", "target", F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"), "hops")


@query(_FLOW + ", w(id, path) AS (SELECT 7::BIGINT, [7::BIGINT] UNION ALL SELECT dst, list_append(path, dst) FROM w JOIN flow ON src = id WHERE len(path) <= 2 AND NOT list_contains(path, dst)), b AS (SELECT id, len(path) - 1 AS hops, path, row_number() OVER (PARTITION BY id ORDER BY len(path), path) AS i FROM w) SELECT id, array_to_string(path, '>') AS path, hops::INT AS hops FROM b WHERE i = 1")
def shortest_path(spark, sf_dir):
    """From one symbol, the shortest way of at most two calls to every symbol."""
    targets = R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    found = graph.shortest_paths(R.kept(spark, sf_dir, R.flow), spark.createDataFrame([(7,)], "id long"), targets, 2)
    return found.select("id", F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"), "hops")


@query(_FLOW + ", w(origin, id, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_size = 1 UNION SELECT origin, dst, depth + 1 FROM w JOIN flow ON src = id WHERE depth < 2) SELECT origin, id, min(depth) AS depth FROM w GROUP BY 1, 2")
def contract_closure(spark, sf_dir):
    """What each contract reaches within two steps; contracts are the symbols of one line."""
    seeds = R.read(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("id"))
    return graph.closure_with_origin(R.kept(spark, sf_dir, R.flow), seeds, 2)


@query(_FLOW + ", w(id, depth) AS (SELECT dst, 1 FROM flow WHERE src = 4 UNION SELECT dst, depth + 1 FROM w JOIN flow ON src = id WHERE depth < 2), c AS (SELECT id, min(depth) AS depth FROM w GROUP BY 1) SELECT c.id AS via, c.depth, flow.dst AS consumer FROM c JOIN flow ON flow.src = c.id")
def transitive_consumers(spark, sf_dir):
    e = R.kept(spark, sf_dir, R.flow).select("src", "dst")
    first = e.where("src = 4").select(F.col("dst").alias("id"))
    near = graph.reach(e, first, 1).select("id", (F.col("depth") + 1).alias("depth"))
    return near.join(e, F.col("id") == F.col("src")).select(F.col("id").alias("via"), "depth", F.col("dst").alias("consumer"))


_STEP = "rank{j} AS MATERIALIZED (SELECT coalesce(f.id, h.id) AS id, 0.85 * coalesce(f.flow, 0) + 0.15 * coalesce(h.home, 0) AS score FROM (SELECT dst AS id, sum(score * p) AS flow FROM rank{i} JOIN pe ON src = id GROUP BY 1) f FULL JOIN home h ON h.id = f.id)"
_PPR = R.CTE["edges"] + ", be AS (SELECT src, dst, n::DOUBLE AS w FROM edges UNION ALL SELECT dst, src, n::DOUBLE FROM edges), tot AS (SELECT src, sum(w) AS t FROM be GROUP BY 1), pe AS (SELECT be.src, dst, sum(w) / any_value(t) AS p FROM be JOIN tot ON tot.src = be.src GROUP BY 1, 2), home AS (SELECT unnest([1::BIGINT, 2::BIGINT]) AS id, 0.5 AS home), rank0 AS (SELECT id, home::DOUBLE AS score FROM home), " + ", ".join(_STEP.format(i=i, j=i + 1) for i in range(20))


@query(f"WITH {_PPR} SELECT id, round(score, 6) AS score FROM rank20 WHERE score > 0 ORDER BY round(score, 6) DESC, id LIMIT 20")
def ppr_topk(spark, sf_dir):
    e = R.kept(spark, sf_dir, R.edges).select("src", "dst", F.col("n").cast("double").alias("weight"))
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    kept = writers.clustered(R.read(spark, sf_dir, "lineitem"), graph.transitions(e), "edge-steps", "src", "dst")
    r = graph.push(kept, spark.createDataFrame([(0, 1), (0, 2), (0, -5)], "query int, id long"))
    return r.select("id", "score").where("score > 0").withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(20)


_BACK = ", ".join(
    f"n{i + 1} AS (SELECT target, way, arg_max(src, (n, -src)) AS prev FROM w{i} JOIN flow ON dst = way[len(way)] AND NOT list_contains(way, src) WHERE NOT done GROUP BY 1, 2), w{i + 1} AS MATERIALIZED (SELECT w{i}.target, CASE WHEN prev IS NULL THEN w{i}.way ELSE list_append(w{i}.way, prev) END AS way, done OR prev IS NULL OR prev IN (SELECT p_partkey FROM part WHERE p_size = 1) AS done FROM w{i} LEFT JOIN n{i + 1} ON n{i + 1}.target = w{i}.target)"
    for i in range(5)
)


@query(R.using("flow") + f", w0 AS (SELECT p_partkey AS target, [p_partkey] AS way, p_size = 1 AS done FROM part), {_BACK} SELECT target, array_to_string(way, '>') AS way FROM w5")
def strongest_way(spark, sf_dir):
    """From every symbol back by the heaviest calls to one of the entry points, five steps at most."""
    p = R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    w = graph.strongest_way(R.kept(spark, sf_dir, R.flow).withColumnRenamed("n", "weight"), p.select("id"), p.where("p_size = 1").select("id"), 5)
    return w.select("target", F.concat_ws(">", F.transform("way", lambda x: x.cast("string"))).alias("way"))


@query(R.using("symbols") + ", s AS (SELECT module || '/' || kind AS module, symbol_id FROM symbols), m AS (SELECT module FROM s GROUP BY 1 HAVING count(*) <= 50) SELECT a.symbol_id AS src, b.symbol_id AS dst, 0.3::DOUBLE AS weight FROM s a JOIN s b ON a.module = b.module AND a.symbol_id <> b.symbol_id WHERE a.module IN (SELECT module FROM m)")
def module_clique(spark, sf_dir):
    s = R.symbols(spark, sf_dir).select(F.concat_ws("/", "module", "kind").alias("module"), "symbol_id")
    return graph.module_clique(s)


@query(R.using("edges") + "SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS nodes, count(*) AS edges, round(count(*) / (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)), 6) AS mean_out FROM edges")
def graph_stats(spark, sf_dir):
    return graph.stats(R.kept(spark, sf_dir, R.edges))


_ENTRY = "CASE WHEN p_name LIKE '%main%' OR p_type LIKE 'STANDARD%' THEN 'cli' WHEN p_type LIKE 'PROMO%' THEN 'api' WHEN p_type LIKE 'LARGE%' THEN 'job' WHEN p_type LIKE 'MEDIUM%' THEN 'event' END"


@query(f"SELECT p_partkey AS id, {_ENTRY} AS entry, count(l_suppkey) AS fan FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey WHERE {_ENTRY} IS NOT NULL GROUP BY 1, 2")
def entrypoints(spark, sf_dir):
    p = R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_ENTRY).alias("entry")).where("entry is not null")
    fan = graph.degrees(R.kept(spark, sf_dir, R.edges)).select((F.col("id") - 1_000_000).alias("id"), F.col("incoming").alias("fan"))
    return p.join(fan, "id", "left").na.fill(0, ["fan"])


# -- intervals -----------------------------------------------------------------------------------------------------------

_DEFS = "defs AS (SELECT p_partkey AS id, p_brand AS doc, p_size::BIGINT * 10 AS start, p_size::BIGINT * 10 + (p_partkey % 40) AS \"end\" FROM part), points AS (SELECT event_id AS pid, 'Brand#' || (1 + user_id % 5) || (1 + event_id % 5) AS doc, (event_id * 37 % 520)::BIGINT AS line FROM events)"


def _spans(spark, sf_dir):
    p = R.read(spark, sf_dir, "part")
    start = F.col("p_size").cast("long") * 10
    defs = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("doc"), start.alias("start"), (start + F.col("p_partkey") % 40).alias("end"))
    e = R.read(spark, sf_dir, "events")
    doc = F.concat(F.lit("Brand#"), (1 + F.col("user_id") % 5).cast("string"), (1 + F.col("event_id") % 5).cast("string"))
    return defs, e.select(F.col("event_id").alias("pid"), doc.alias("doc"), (F.col("event_id") * 37 % 520).alias("line"))


@query(f'WITH {_DEFS} SELECT pid, arg_min(id, ("end" - start, -start, id)) AS id FROM points JOIN defs ON defs.doc = points.doc AND line BETWEEN start AND "end" GROUP BY 1')
def interval_container(spark, sf_dir):
    defs, points = _spans(spark, sf_dir)
    return intervals.innermost(points, defs)


@query(f"WITH {_DEFS} SELECT id, doc, start, coalesce(lead(start) OVER (PARTITION BY doc ORDER BY start, id) - 1, start + 500) AS \"end\" FROM defs")
def function_ranges_lead(spark, sf_dir):
    return intervals.close(_spans(spark, sf_dir)[0]).select("id", "doc", "start", "end")


@query(f"WITH {_DEFS} SELECT pid, arg_max(id, (start, id)) AS id FROM points JOIN defs ON defs.doc = points.doc AND start <= line GROUP BY 1")
def enclosing_definition(spark, sf_dir):
    defs, points = _spans(spark, sf_dir)
    return intervals.enclosing(points, defs)


@query(f'WITH {_DEFS}, c AS (SELECT pid, arg_min(id, ("end" - start, -start, id)) AS id FROM points JOIN defs ON defs.doc = points.doc AND line BETWEEN start AND "end" GROUP BY 1) SELECT id AS caller, count(*) AS calls, count(DISTINCT user_id) AS callees FROM c JOIN events ON event_id = pid GROUP BY 1')
def callers_by_interval(spark, sf_dir):
    defs, points = _spans(spark, sf_dir)
    e = R.read(spark, sf_dir, "events").select(F.col("event_id").alias("pid"), "user_id")
    return intervals.innermost(points, defs).join(e, "pid").groupBy(F.col("id").alias("caller")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("user_id").alias("callees"))
