"""Queries over service state: schedules, queues, caches, health and envelopes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.operators import jobs, service
from loam.plans.catalog import query
from loam.sources import relations as R

_SCHEDULE = """CASE o_orderkey % 7 WHEN 0 THEN 'every 4h' WHEN 1 THEN 'Daily at 2:30' WHEN 2 THEN '*/15 9-17 * * 1-5' WHEN 3 THEN '0 0 1 * *' WHEN 4 THEN '30 6 15 2,3 0' WHEN 5 THEN 'every 30 s' ELSE '61 * * * *' END"""
_FROM = "o_orderdate + INTERVAL (o_orderkey % 1440) MINUTE"


@query(
    f"""WITH s AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k, {_SCHEDULE} AS expression, {_FROM} AS t, date_trunc('day', {_FROM}) AS d FROM orders),
m AS (SELECT *, date_diff('minute', d, t) AS now FROM s),
n AS (SELECT id, expression, t, CASE k WHEN 0 THEN t + INTERVAL 4 HOUR WHEN 1 THEN CASE WHEN now < 150 THEN d + INTERVAL 150 MINUTE ELSE d + INTERVAL 1590 MINUTE END
WHEN 2 THEN CASE WHEN now < 540 THEN d + INTERVAL 540 MINUTE WHEN now < 1065 THEN d + to_minutes((now // 15 + 1) * 15) ELSE d + INTERVAL 1980 MINUTE END
WHEN 3 THEN d + INTERVAL 1 DAY
WHEN 4 THEN (SELECT min(x + INTERVAL 390 MINUTE) FROM (SELECT d + to_days(CAST(i AS INT)) AS x FROM range(0, 367) r(i)) WHERE month(x) IN (2, 3) AND (day(x) = 15 OR dayofweek(x) = 0) AND x + INTERVAL 390 MINUTE > t) END AS next FROM m)
SELECT id, expression, strftime(next, '%Y-%m-%d %H:%M') AS next FROM n"""
)
def next_fire(spark, sf_dir):
    """When each of several schedules runs next, from a time of its own."""
    o = R.read(spark, sf_dir, "orders")
    after = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 1440 * 60_000_000)
    s = o.select(F.col("o_orderkey").alias("id"), F.expr(_SCHEDULE.replace("CASE o_orderkey % 7", "CASE int(o_orderkey % 7)")).alias("expression"), after.alias("t"))
    return service.next_run(s, "t").select("id", "expression", F.date_format("next", "yyyy-MM-dd HH:mm").alias("next"))


@query("SELECT id, place FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P') WHERE place <= 50")
def pending_jobs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "P", "queued").otherwise("completed")
    jobs = R.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("created"))
    return service.pending(jobs, 50).select("id", F.col("place").cast("long").alias("place"))


@query("WITH c AS (SELECT (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01') AS changed, (SELECT count(*) FROM orders) AS total) SELECT changed, total, changed * 100 // total AS percent, CASE WHEN changed = 0 THEN 'unchanged' WHEN changed * 100 // total > 50 THEN 'full' ELSE 'incremental' END AS decision FROM c")
def refresh_decision(spark, sf_dir):
    o = R.read(spark, sf_dir, "orders")
    return service.refresh_decision(o.where("o_orderdate >= timestamp '2001-01-01'"), o)


@query("WITH m AS (SELECT c_nationkey AS repo, count(*) AS n, CASE WHEN c_nationkey % 4 = 0 THEN 'full' WHEN c_nationkey % 4 < 3 THEN 'partial' END AS st, c_nationkey % 3 = 0 AS dirty, count(*) FILTER (WHERE c_acctbal < -900) AS pending FROM customer GROUP BY 1) SELECT repo, CASE WHEN pending > 0 THEN 'pending' WHEN dirty AND st IS NOT NULL THEN st || '_dirty' ELSE coalesce(st, 'unknown') END AS state, n AS last_full, 0::BIGINT AS last_incremental, n * 2 AS files_since_full, pending FROM m")
def index_states(spark, sf_dir):
    c = R.read(spark, sf_dir, "customer")
    n = c.groupBy(F.col("c_nationkey").alias("repo")).agg(F.count(F.lit(1)).alias("n"))
    state = F.expr("case when repo % 4 = 0 then 'full' when repo % 4 < 3 then 'partial' end")
    marks = {"state": state, "last_full": F.col("n").cast("string"), "files_since_full": (F.col("n") * 2).cast("string"), "dirty": (F.col("repo") % 3 == 0).cast("string")}
    meta = n.select("repo", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in marks.items()])).alias("m")).select("repo", "m.key", "m.value")
    return service.index_state(meta, c.where("c_acctbal < -900").select(F.col("c_nationkey").alias("repo")))


@query("WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS a, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS b FROM orders) SELECT id, sha256(id || ':' || sha256(a) || ':' || sha256(b) || ':' || sha256('')) AS state, a <> '' OR b <> '' AS dirty FROM t")
def repository_states(spark, sf_dir):
    o = R.read(spark, sf_dir, "orders")
    staged = F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderpriority"))
    working = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    state, dirty = service.state_id(F.col("o_orderkey").cast("string"), staged, working, F.lit(""))
    return o.select(F.col("o_orderkey").alias("id"), state.alias("state"), dirty.alias("dirty"))


@query("SELECT count(*) AS backends, count(*) FILTER (WHERE s_acctbal > 0) AS available, count(*) FILTER (WHERE s_acctbal > 0 AND s_acctbal <= 500) AS broken, count(*) FILTER (WHERE s_acctbal > 0 AND s_acctbal <= 500) = 0 AS healthy FROM supplier")
def backend_health(spark, sf_dir):
    return service.health(R.read(spark, sf_dir, "supplier").select((F.col("s_acctbal") > 0).alias("available"), (F.col("s_acctbal") > 500).alias("healthy")))


_CHECK = "CASE WHEN s_acctbal < 0 THEN 'fail' WHEN s_acctbal < 5000 THEN 'warn' ELSE 'pass' END"


@query(f"WITH c AS (SELECT 'check' || (s_nationkey % 5) AS name, {_CHECK} AS status FROM supplier) SELECT status, count(*) AS n, array_to_string(list_sort(list(DISTINCT name)), ',') AS names, CASE status WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS rank FROM c GROUP BY 1")
def diagnostics(spark, sf_dir):
    s = R.read(spark, sf_dir, "supplier")
    return service.diagnose(s.select(F.concat(F.lit("check"), (F.col("s_nationkey") % 5).cast("string")).alias("name"), F.expr(_CHECK).alias("status")))


_CACHE = "c AS (SELECT user_id AS key, arg_max(event_type, (ts, event_type, props)) AS state, arg_max(props, (ts, event_type, props)) AS value, max(ts) AS created FROM events GROUP BY 1)"
_NOW = "2024-01-29 12:00:00"


def _cache(spark, sf_dir):
    e = R.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("state"), F.col("props").alias("value"), F.col("ts").cast("timestamp").alias("created"))
    early, late = e.where("created < timestamp '2024-01-15'"), e.where("created >= timestamp '2024-01-15'")
    none = early.limit(0).withColumn("expires", F.col("created"))
    return service.cache_put(service.cache_put(none, early, F.lit(86400)), late, F.lit(86400))


@query(f"WITH {_CACHE}, w AS (SELECT DISTINCT user_id AS key, event_type AS state FROM events) SELECT w.key, w.state, c.key IS NOT NULL AS hit, c.value FROM w LEFT JOIN c ON c.key = w.key AND c.state = w.state AND c.created + INTERVAL 1 DAY >= TIMESTAMP '{_NOW}'")
def cache_lookup(spark, sf_dir):
    """Entries live for a day and answer for their state only."""
    wanted = R.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("state")).distinct()
    return service.cache_get(_cache(spark, sf_dir), wanted, F.lit(_NOW).cast("timestamp"))


@query(f"WITH {_CACHE} SELECT key, state FROM c WHERE created + INTERVAL 1 DAY >= TIMESTAMP '{_NOW}' AND state NOT IN ('click', 'view')")
def cache_invalidation(spark, sf_dir):
    states = spark.createDataFrame([("click",), ("view",)], "state string")
    return service.cache_drop(_cache(spark, sf_dir), states, F.lit(_NOW).cast("timestamp")).select("key", "state")


_ERROR = "CASE event_id % 7 WHEN 0 THEN 'symbol-not-found' WHEN 1 THEN 'backend-unavailable' WHEN 2 THEN 'workspace-not-ready' WHEN 3 THEN 'timeout' WHEN 4 THEN 'index-not-found' WHEN 5 THEN 'parse-error' ELSE 'other' END"


@query(f"WITH e AS (SELECT {_ERROR} AS kind FROM events) SELECT kind, CASE kind WHEN 'backend-unavailable' THEN 15 WHEN 'workspace-not-ready' THEN 10 WHEN 'timeout' THEN 5 ELSE 60 END AS seconds, kind = 'workspace-not-ready' AS warm, count(*) AS n FROM e GROUP BY 1")
def error_memory(spark, sf_dir):
    kind = F.expr(_ERROR.replace("CASE event_id % 7", "CASE int(event_id % 7)"))
    e = R.read(spark, sf_dir, "events").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("kind", service.error_seconds(F.col("kind")).alias("seconds"), F.col("kind").isin(*service.WARMING).alias("warm"), "n")


@query("SELECT user_id AS key, strftime(time_bucket(INTERVAL 2 HOUR, ts), '%Y-%m-%d %H') AS start, arg_min(event_id, (ts, event_id)) AS leader, count(*) AS shared FROM events GROUP BY 1, 2")
def coalesced_requests(spark, sf_dir):
    r = R.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return service.coalesced(r, "2 hours").withColumn("start", F.date_format("start", "yyyy-MM-dd HH"))


@query("WITH r AS (SELECT event_id AS id, event_type = 'purchase' AS spared, row_number() OVER (PARTITION BY date_trunc('hour', ts), event_type = 'purchase' ORDER BY ts, event_id) AS i FROM events) SELECT id, spared OR i <= 8 AS accepted FROM r")
def load_shedding(spark, sf_dir):
    r = R.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return service.shed(r, "1 hour", 8, F.col("event_type") == "purchase")


@query("SELECT item_id, replace(replace(replace(replace('\"' || text || '(*)', '\"', '\"\"'), '*', '\\*'), '(', '\\('), ')', '\\)') AS escaped FROM benchmark")
def match_escape(spark, sf_dir):
    b = R.read(spark, sf_dir, "benchmark")
    return b.select("item_id", service.match_query(F.concat(F.lit('"'), "text", F.lit("(*)"))).alias("escaped"))


@query("WITH c AS (SELECT p_partkey AS id, p_type AS preset, '{\"v\":1,\"p\":\"' || p_type || '\",\"o\":' || p_partkey || ',\"h\":\"' || md5(p_brand) || '\"}' AS body, p_size FROM part) SELECT id, rtrim(replace(replace(base64(encode(body)), '+', '-'), '/', '_'), '=') AS cursor, CASE WHEN p_size % 3 > 0 THEN id END AS place FROM c")
def page_cursors(spark, sf_dir):
    """Cursors and what they lead to; a third of the lists have changed since."""
    p = R.read(spark, sf_dir, "part").withColumn("cursor", service.page_cursor(F.col("p_type"), F.col("p_partkey"), F.md5("p_brand")))
    now = F.md5(F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).otherwise(F.lit("new")))
    return p.select(F.col("p_partkey").alias("id"), "cursor", service.read_cursor(F.col("cursor"), F.col("p_type"), now).alias("place"))


@query("SELECT least(count(*), 100) AS shown, count(*) AS total, count(*) > 100 AS truncated, 7 AS behind, 'medium' AS tier, 'partial,stale' AS warnings FROM orders")
def answer_envelope(spark, sf_dir):
    o = R.read(spark, sf_dir, "orders")
    return service.envelope(o, 100, F.lit(7), F.lit("high"), F.when(F.col("o_orderkey") % 2 == 0, "stale").otherwise("partial"))


# -- work that leaves the engine ---------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, strftime(o_orderdate + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M') AS next FROM orders WHERE o_orderkey % 2 = 0 AND o_orderdate + INTERVAL 4 HOUR <= TIMESTAMP '1998-01-01' UNION ALL SELECT o_orderkey, strftime(date_trunc('day', o_orderdate) + INTERVAL 1590 MINUTE, '%Y-%m-%d %H:%M') FROM orders WHERE o_orderkey % 2 = 1 AND date_trunc('day', o_orderdate) + INTERVAL 1590 MINUTE <= TIMESTAMP '1998-01-01' AND o_orderdate >= date_trunc('day', o_orderdate) + INTERVAL 150 MINUTE UNION ALL SELECT o_orderkey, strftime(date_trunc('day', o_orderdate) + INTERVAL 150 MINUTE, '%Y-%m-%d %H:%M') FROM orders WHERE o_orderkey % 2 = 1 AND date_trunc('day', o_orderdate) + INTERVAL 150 MINUTE <= TIMESTAMP '1998-01-01' AND o_orderdate < date_trunc('day', o_orderdate) + INTERVAL 150 MINUTE")
def due_schedules(spark, sf_dir):
    o = R.read(spark, sf_dir, "orders")
    s = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "every 4h").otherwise("daily at 2:30").alias("expression"), F.col("o_orderdate").cast("timestamp").alias("last"))
    return jobs.due(s, F.lit("1998-01-01").cast("timestamp")).select("id", F.date_format("next", "yyyy-MM-dd HH:mm").alias("next"))


@query("SELECT o_orderkey AS id, o_orderstatus AS kind, CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_totalprice > 1000) THEN 'completed' ELSE 'failed' END AS status, CASE WHEN o_orderstatus = 'F' THEN upper(o_orderpriority) WHEN o_orderstatus = 'O' AND o_totalprice > 1000 THEN CAST(length(o_orderpriority) AS VARCHAR) END AS result FROM orders")
def job_results(spark, sf_dir):
    """Jobs of three kinds: one has no handler, and one handler gives up on some."""
    j = R.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("scope"), "o_totalprice")
    handlers = {"F": lambda df: df.select("id", F.upper("scope").alias("result")), "O": lambda df: df.where("o_totalprice > 1000").select("id", F.length("scope").alias("result"))}
    return jobs.handled(j, handlers)


def _post(key: int, body: str, signature: str, attempt: int) -> bool:
    """A receiver that works at the first try, a later one, or never."""
    if key % 5 == 4:
        raise ConnectionError("no answer")
    return key % 5 < attempt


@query("SELECT event_id AS id, CASE WHEN event_id % 5 < 3 THEN 'delivered' ELSE 'dead' END AS status, CAST(least(event_id % 5 + 1, 3) AS INT) AS attempts FROM events")
def event_delivery(spark, sf_dir):
    e = R.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("body"))
    return jobs.deliver(e, _post, b"secret").select("id", "status", "attempts")


def _page(address: str, cursor: str) -> str:
    """A member's table in pages of ten, without a network; every fifth member breaks after its second page."""
    import json

    key, at = int(address.rsplit("/", 1)[1]), int(cursor or 0)
    if key % 5 == 0 and at >= 20:
        raise ConnectionError("gone")
    last = key % 4 * 10 + 7
    return json.dumps({"rows": [{"id": i, "name": f"s{key}-{i}"} for i in range(at, min(at + 10, last))], "next": str(at + 10) if at + 10 < last else None})


@query("WITH m AS (SELECT n_nationkey AS k, n_nationkey % 4 * 10 + 7 AS n FROM nation), r AS (SELECT k, unnest(range(0, CASE WHEN k % 5 = 0 THEN least(n, 20) ELSE n END)) AS i FROM m) SELECT 'r' || k AS repo, count(*) AS rows, CAST(sum(i) AS BIGINT) AS ids, max(CASE WHEN k % 5 = 0 AND (k % 4 * 10 + 7) > 20 THEN 1 ELSE 0 END) AS failed FROM r GROUP BY 1")
def remote_members(spark, sf_dir):
    m = R.read(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("repo"), F.concat(F.lit("mem://x/"), F.col("n_nationkey").cast("string")).alias("address"))
    r = jobs.remote_rows(m, _page, "id long, name string")
    return r.groupBy("repo").agg(F.count("row").alias("rows"), F.sum("row.id").alias("ids"), F.max(F.col("error").isNotNull().cast("int")).alias("failed"))


# -- signed pages ----------------------------------------------------------------------------------------------------------------

_SECRET = b"page secret"
_PADS = {name: bytes(k ^ byte for k in _SECRET.ljust(64, b"\0")).hex() for name, byte in (("inner", 0x36), ("outer", 0x5C))}
_CURSOR = (
    "p AS (SELECT o_custkey AS owner, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), "
    "e AS (SELECT owner, k, '{\"e\":\"order\",\"pk\":\"' || k || '\"}' AS body FROM p WHERE n % 5 = 0), "
    f"s AS (SELECT owner, k, body, unhex(sha256(unhex('{_PADS['outer']}') || unhex(sha256(unhex('{_PADS['inner']}') || encode(body))))) AS mark FROM e), "
    "c AS (SELECT owner, k, rtrim(translate(base64(encode(body)), '+/', '-_'), '=') || '.' || rtrim(translate(base64(mark), '+/', '-_'), '=') AS cursor FROM s)"
)


@query(f"WITH {_CURSOR}, r AS (SELECT owner, k, cursor, k % 3 = 0 AS forged FROM c) SELECT owner, r.k AS last, cursor, CASE WHEN forged THEN NULL ELSE (SELECT count(*) FROM orders WHERE o_custkey = owner AND o_orderkey > r.k) END AS remaining FROM r")
def signed_pages(spark, sf_dir):
    """Every customer's orders in pages of five: each page's signed cursor, a third of them forged, and how many orders lie behind those that hold."""
    o = R.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("k"))
    by = Window.partitionBy("owner").orderBy("k")
    pages = o.select("*", F.row_number().over(by).alias("n")).where("n % 5 = 0").select("owner", F.col("k").alias("last"))
    cursor = service.signed_cursor(F.lit("order"), F.col("last").cast("string"), _SECRET)
    pages = pages.withColumn("cursor", cursor)
    given = F.when(F.col("last") % 3 == 0, F.concat(service.signed_cursor(F.lit("order"), F.lit("0"), b"another"))).otherwise(F.col("cursor"))
    read = pages.withColumn("after", service.read_signed_cursor(given, F.lit("order"), _SECRET).cast("long"))
    behind = read.where("after is not null").join(o.withColumnRenamed("owner", "of"), (F.col("of") == F.col("owner")) & (F.col("k") > F.col("after")), "left")
    counts = behind.groupBy(F.col("owner").alias("w"), F.col("last").alias("l")).agg(F.count("k").alias("remaining"))
    return read.join(counts, (F.col("owner") == F.col("w")) & (F.col("last") == F.col("l")), "left").select("owner", "last", "cursor", "remaining")
