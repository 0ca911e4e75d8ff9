"""Queries over runtime usage and score snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.scoring import privacy_hash
from loam.operators import series, usage
from loam.plans.catalog import query
from loam.sources import relations as R

_ERR = "count(*) FILTER (WHERE value < 0.1) AS errors"


@query(R.using("calls") + f"SELECT function, strftime(ts, '%Y-%m-%d') AS period, count(*) AS calls, {_ERR} FROM calls GROUP BY 1, 2")
def period_daily(spark, sf_dir):
    return usage.by_period(R.calls(spark, sf_dir), "daily").drop("period_start")


@query(R.using("calls") + f"SELECT function, strftime(ts, '%G-W%V') AS period, count(*) AS calls, {_ERR} FROM calls GROUP BY 1, 2")
def period_weekly(spark, sf_dir):
    return usage.by_period(R.calls(spark, sf_dir), "weekly").drop("period_start")


@query(R.using("calls") + f"SELECT function, strftime(ts, '%Y-%m') AS period, count(*) AS calls, {_ERR} FROM calls GROUP BY 1, 2")
def period_monthly(spark, sf_dir):
    return usage.by_period(R.calls(spark, sf_dir), "monthly").drop("period_start")


@query(R.using("calls") + "SELECT function, service, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM calls GROUP BY 1, 2")
def usage_upsert(spark, sf_dir):
    """State of the first half of the month, then the second half added."""
    c = R.calls(spark, sf_dir).select("function", "service", "ts", F.lit(1).cast("long").alias("n"), "k")
    keys = ["function", "service"]
    state = c.where("ts < timestamp '2024-01-15'").groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    return usage.upsert_add(state, c.where("ts >= timestamp '2024-01-15'"), keys, ["n", "k"])


_OLDNEW = "o AS (SELECT user_id AS service, max(value) AS v, min(event_type) AS t FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), w AS (SELECT user_id AS service, max(value) AS v, CASE WHEN user_id % 2 = 0 THEN max(event_type) END AS t FROM events WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY 1)"


def _old_new(spark, sf_dir):
    c = R.calls(spark, sf_dir)
    old = c.where("ts < timestamp '2024-01-10'").groupBy("service").agg(F.max("value").alias("v"), F.min("function").alias("t"))
    new = c.where("ts >= timestamp '2024-01-25'").groupBy("service").agg(F.max("value").alias("v"), F.max("function").alias("t"))
    return old, new.withColumn("t", F.when(F.col("service") % 2 == 0, F.col("t")))


@query(f"WITH {_OLDNEW} SELECT * FROM w UNION ALL SELECT * FROM o WHERE service NOT IN (SELECT service FROM w)")
def replace_upsert(spark, sf_dir):
    return usage.upsert_replace(*_old_new(spark, sf_dir), ["service"])


@query(f"WITH {_OLDNEW} SELECT coalesce(w.service, o.service) AS service, coalesce(w.v, o.v) AS v, coalesce(w.t, o.t) AS t FROM o FULL JOIN w ON w.service = o.service")
def patch_upsert(spark, sf_dir):
    return usage.upsert_patch(*_old_new(spark, sf_dir), "service")


#: Calls stand in for telemetry: the k of an event picks the file, its hour the line.
_MATCH = """sym AS (SELECT p_partkey AS symbol_id, split_part(p_name, ' ', 1) AS name, p_size AS line, p_brand AS file, p_type AS namespace FROM part),
cl AS (SELECT e.event_id AS call_id, s.name, CASE WHEN e.event_id % 3 = 0 THEN s.file ELSE 'none' END AS file, CASE WHEN e.event_id % 2 = 0 THEN s.namespace ELSE 'other' END AS namespace, CASE WHEN e.event_id % 5 < 3 THEN s.line ELSE 0 END AS line FROM events e JOIN sym s ON s.symbol_id = e.event_id % (SELECT count(*) FROM part) + 1),
ex AS (SELECT file, line, name, min(symbol_id) AS id FROM sym GROUP BY ALL), st AS (SELECT file, name, min(symbol_id) AS id, count(*) AS n FROM sym GROUP BY ALL), we AS (SELECT namespace, name, min(symbol_id) AS id, count(*) AS n FROM sym GROUP BY ALL), an AS (SELECT name, min(symbol_id) AS id, count(*) AS n FROM sym GROUP BY ALL),
matched AS (SELECT call_id, CASE WHEN ex.id IS NOT NULL THEN ex.id WHEN st.n = 1 THEN st.id WHEN we.n = 1 THEN we.id WHEN we.n > 1 THEN NULL WHEN an.n = 1 THEN an.id END AS symbol_id,
 CASE WHEN ex.id IS NOT NULL THEN 'exact' WHEN st.n = 1 THEN 'strong' WHEN we.n = 1 THEN 'weak' WHEN we.n > 1 THEN 'unmatched' WHEN an.n = 1 THEN 'weak' ELSE 'unmatched' END AS quality,
 CAST(CASE WHEN ex.id IS NOT NULL THEN 0.95 WHEN st.n = 1 THEN 0.85 WHEN we.n = 1 THEN 0.6 WHEN we.n > 1 THEN 0 WHEN an.n = 1 THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence
 FROM cl LEFT JOIN ex ON ex.file = cl.file AND ex.line = cl.line AND ex.name = cl.name LEFT JOIN st ON st.file = cl.file AND st.name = cl.name LEFT JOIN we ON we.namespace = cl.namespace AND we.name = cl.name LEFT JOIN an ON an.name = cl.name)"""


def _matched(spark, sf_dir):
    p = R.read(spark, sf_dir, "part")
    sym = p.select(F.col("p_partkey").alias("symbol_id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"), F.col("p_size").alias("line"), F.col("p_brand").alias("file"), F.col("p_type").alias("namespace"))
    n = p.agg(F.count(F.lit(1)).alias("parts"))
    e = R.read(spark, sf_dir, "events").select("event_id").crossJoin(F.broadcast(n)).withColumn("at", F.col("event_id") % F.col("parts") + 1)  # one row
    c = e.join(sym, F.col("at") == F.col("symbol_id"))
    pick = lambda cond, c, other: F.when(cond, F.col(c)).otherwise(F.lit(other)).alias(c)
    c = c.select(F.col("event_id").alias("call_id"), "name", pick(F.expr("event_id % 3 = 0"), "file", "none"), pick(F.expr("event_id % 2 = 0"), "namespace", "other"), pick(F.expr("event_id % 5 < 3"), "line", 0))
    return usage.tiered_match(c, sym)


@query(f"WITH {_MATCH} SELECT * FROM matched")
def tiered_match(spark, sf_dir):
    return _matched(spark, sf_dir)


@query(f"WITH {_MATCH} SELECT count(DISTINCT symbol_id) FILTER (WHERE quality = 'exact') AS exact, count(DISTINCT symbol_id) FILTER (WHERE quality = 'strong') AS strong, count(DISTINCT symbol_id) FILTER (WHERE quality = 'weak') AS weak, count(DISTINCT symbol_id) FILTER (WHERE quality = 'unmatched') AS unmatched FROM matched")
def match_stats_distinct(spark, sf_dir):
    return usage.distinct_by_quality(_matched(spark, sf_dir))


@query(
    f"""WITH {_MATCH}, r AS (SELECT round(0.5 * avg((call_id % 3 = 0)::INT) + 0.3 * avg((call_id % 2 = 0)::INT) + 0.2 * avg((call_id % 5 < 3)::INT), 6) AS attributes, round(avg((quality IN ('exact', 'strong'))::INT), 6) AS effective, round(avg((quality <> 'unmatched')::INT), 6) AS matched FROM matched),
o AS (SELECT *, round(0.3 * attributes + 0.5 * effective + 0.2 * matched, 6) AS overall FROM r) SELECT *, CASE WHEN overall >= 0.8 THEN 'high' WHEN overall >= 0.6 THEN 'medium' WHEN overall >= 0.3 THEN 'low' ELSE 'insufficient' END AS level FROM o"""
)
def telemetry_coverage(spark, sf_dir):
    m = _matched(spark, sf_dir).withColumns({"has_file": F.expr("call_id % 3 = 0"), "has_namespace": F.expr("call_id % 2 = 0"), "has_line": F.expr("call_id % 5 < 3")})
    return usage.quality_coverage(m)


@query(f"WITH {_MATCH}, u AS (SELECT symbol_id, count(*) AS calls FROM matched WHERE quality IN ('exact', 'strong') GROUP BY 1) SELECT p_partkey AS symbol_id, p_name AS name, round(least(0.9, CASE WHEN p_size > 25 THEN 0.8 ELSE 0.9 END * 0.85), 6)::DOUBLE AS confidence FROM part LEFT JOIN u ON symbol_id = p_partkey WHERE coalesce(calls, 0) = 0 AND round(least(0.9, CASE WHEN p_size > 25 THEN 0.8 ELSE 0.9 END * 0.85), 6) >= 0.7 ORDER BY confidence DESC, symbol_id LIMIT 100")
def dead_code(spark, sf_dir):
    u = _matched(spark, sf_dir).where("quality in ('exact', 'strong')").groupBy("symbol_id").agg(F.count(F.lit(1)).alias("calls"))
    s = R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), (F.col("p_size") > 25).alias("exported"))
    return usage.unused(s, u, 0.7, 0.85).select("symbol_id", "name", "confidence").orderBy(F.desc("confidence"), "symbol_id").limit(100)


@query(f"WITH {_MATCH} SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, round(avg(confidence), 6) AS mean FROM matched GROUP BY 1")
def confidence_bands(spark, sf_dir):
    band = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low")
    return _matched(spark, sf_dir).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


@query("SELECT user_id AS service, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS calls FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1 HAVING sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 0")
def zero_calls_having(spark, sf_dir):
    c = R.calls(spark, sf_dir).where("ts >= timestamp '2024-01-20'")
    return c.groupBy("service").agg(F.sum(F.when(F.col("function") == "purchase", 1).otherwise(0)).alias("calls")).where("calls = 0")


@query("SELECT event_type AS function, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS days, count(*) AS n FROM events GROUP BY 1")
def observation_window(spark, sf_dir):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return R.calls(spark, sf_dir).groupBy("function").agg(day(F.min("ts")).alias("first_day"), day(F.max("ts")).alias("last_day"), F.datediff(F.max("ts").cast("date"), F.min("ts").cast("date")).cast("long").alias("days"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT user_id AS service FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY 1 LIMIT 20")
def unmapped_services(spark, sf_dir):
    known = R.read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("service"))
    return R.calls(spark, sf_dir).select("service").distinct().join(known, "service", "left_anti").orderBy("service").limit(20)


@query("SELECT count(*) AS events, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 24 HOUR AND ts < TIMESTAMP '2024-01-29 12:00:00'")
def sliding_day_sum(spark, sf_dir):
    c = R.calls(spark, sf_dir).where("ts >= timestamp '2024-01-28 12:00:00' and ts < timestamp '2024-01-29 12:00:00'")
    return c.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))


@query(
    R.using("calls")
    + """, d AS (SELECT service, CAST(ts AS DATE) AS day, count(*) AS n FROM calls GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY day DESC) AS i, count(*) OVER (PARTITION BY service) // 2 AS half FROM d),
h AS (SELECT service, CAST(sum(CASE WHEN i <= half THEN n ELSE 0 END) AS BIGINT) AS recent, CAST(sum(CASE WHEN i > half THEN n ELSE 0 END) AS BIGINT) AS older, count(*) AS c FROM r GROUP BY 1)
SELECT service, recent, older, CASE WHEN c < 2 THEN 'stable' WHEN older = 0 AND recent > 0 THEN 'increasing' WHEN older = 0 THEN 'stable' WHEN recent / older > 1.2 THEN 'increasing' WHEN recent / older < 0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM h"""
)
def usage_trend_half(spark, sf_dir):
    d = R.calls(spark, sf_dir).groupBy("service", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return usage.half_trend(d, "service", "day", "n")


@query(R.using("calls") + ", r AS (SELECT service, count(*) AS n, avg((k % 10 = 0)::INT) AS s FROM calls GROUP BY 1) SELECT service, n, round(s, 6) AS round_share, n > 100 AND s > 0.8 AS sampled FROM r")
def sampling_detect(spark, sf_dir):
    return usage.sampling(R.calls(spark, sf_dir))


@query(
    R.using("calls")
    + ", r AS (SELECT function, count(*) AS runs, CAST(sum(k) AS BIGINT) AS items, CAST(sum(CASE WHEN k > 50 THEN k - 50 ELSE 0 END) AS BIGINT) AS dropped, sum(value) AS ms FROM calls GROUP BY 1) SELECT function, runs, items, dropped, round(coalesce(dropped / nullif(items, 0), 0), 6)::DOUBLE AS truncation, round(ms / runs, 6) AS mean_ms FROM r"
)
def wide_metrics_rollup(spark, sf_dir):
    return usage.rollup_metrics(R.calls(spark, sf_dir), "function")


@query(R.using("calls") + ", s AS (SELECT function, service, count(*) AS n FROM calls GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY function ORDER BY n DESC, service) AS i FROM s) SELECT function, CAST(sum(n) AS BIGINT) AS calls, string_agg(service::VARCHAR, ',' ORDER BY i) FILTER (WHERE i <= 5) AS top_callers FROM r GROUP BY 1")
def usage_summary(spark, sf_dir):
    s = R.calls(spark, sf_dir).groupBy("function", "service").agg(F.count(F.lit(1)).alias("n"))
    # The five largest of each function come from a window; sums come from all.
    from pyspark.sql import Window

    r = s.withColumn("i", F.row_number().over(Window.partitionBy("function").orderBy(F.desc("n"), "service")))
    top = F.array_sort(F.collect_list(F.when(F.col("i") <= 5, F.struct("i", "service"))))
    return r.groupBy("function").agg(F.sum("n").alias("calls"), F.array_join(F.transform(top, lambda x: x["service"].cast("string")), ",").alias("top_callers"))


@query("SELECT event_type AS function, count(*) AS n FROM events WHERE value > 50 GROUP BY 1 ORDER BY n DESC, function LIMIT 3")
def top_callers(spark, sf_dir):
    return R.calls(spark, sf_dir).where("value > 50").groupBy("function").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "function").limit(3)


@query("SELECT DISTINCT event_type AS function, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 20")
def json_extract_filter(spark, sf_dir):
    return R.calls(spark, sf_dir).where("k between 10 and 20").select("function", "k").distinct()


@query("SELECT s_suppkey AS service, CASE WHEN s_name = 'Supplier#000000001' THEN 'core' WHEN regexp_matches(s_name, '^Supplier#0*(\\d)$') THEN regexp_replace(s_name, '^Supplier#0*(\\d)$', 'one-\\1') WHEN regexp_matches(s_name, '^Supplier#0*(\\d+)[05]$') THEN regexp_replace(s_name, '^Supplier#0*(\\d+)[05]$', 'five-\\1') END AS repo FROM supplier".replace("s_suppkey AS service", "s_name AS service"))
def service_map_regex(spark, sf_dir):
    s = R.read(spark, sf_dir, "supplier").select(F.col("s_name").alias("service"))
    return usage.map_services(s, {"Supplier#000000001": "core"}, [(r"^Supplier#0*(\d)$", "one-$1"), (r"^Supplier#0*(\d+)[05]$", "five-$1")])


@query(
    "WITH RECURSIVE n AS (SELECT DISTINCT s_name AS name FROM supplier), w(name, i, h) AS (SELECT name, 0, 0::BIGINT FROM n UNION ALL SELECT name, i + 1, (h * 31 + ascii(name[i + 1])) % 65536 FROM w WHERE i < length(name)) SELECT name, substr(name, 1, 3) || '-' || lpad(lower(printf('%x', h)), 4, '0') AS hashed FROM w WHERE i = length(name)"
)
def redaction_hash(spark, sf_dir):
    return R.read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")).distinct().withColumn("hashed", privacy_hash(F.col("name")))


@query("SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_name ELSE '' END AS name, regexp_replace(p_brand, '^Brand', '') AS path, split_part(p_type, ' ', -1) AS base FROM part")
def redaction(spark, sf_dir):
    p = R.read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_name")).otherwise("").alias("name"), F.regexp_replace("p_brand", "^Brand", "").alias("path"), F.element_at(F.split("p_type", " "), -1).alias("base"))


@query(
    R.using("snapshots")
    + """, x AS (SELECT target, date, score, date_diff('day', min(date) OVER (PARTITION BY target), date) AS x FROM snapshots), t AS (SELECT target, count(*) AS points, coalesce(regr_slope(score, x), 0) AS slope, arg_max(score, date) AS last FROM x GROUP BY 1)
SELECT target, points, round(slope, 4) AS slope, CASE WHEN points < 2 THEN 'stable' WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS direction, round(greatest(0, last + slope * 30), 4) AS projection FROM t"""
)
def trend_regression(spark, sf_dir):
    return series.trend(R.snapshots(spark, sf_dir))


@query(R.using("snapshots") + "SELECT target, strftime(date, '%Y-%m-%d') AS date, score FROM snapshots QUALIFY row_number() OVER (PARTITION BY target ORDER BY date DESC) = 1")
def latest_snapshot(spark, sf_dir):
    return series.latest(R.snapshots(spark, sf_dir)).select("target", F.col("date").cast("string").alias("date"), "score")


@query(R.using("snapshots") + "SELECT strftime(date, '%Y-%m-%d') AS date, target, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, target) AS rank FROM snapshots QUALIFY rank <= 3")
def top_n_per_day(spark, sf_dir):
    return series.top_per_date(R.snapshots(spark, sf_dir), 3).select(F.col("date").cast("string").alias("date"), "target", "score", F.col("rank").cast("long").alias("rank"))


@query(R.using("snapshots") + "SELECT target, strftime(date, '%Y-%m-%d') AS date FROM snapshots QUALIFY row_number() OVER (PARTITION BY target ORDER BY date DESC) <= 5 OR date >= DATE '2001-01-01'")
def retention(spark, sf_dir):
    return series.retain(R.snapshots(spark, sf_dir), 5, "2001-01-01").select("target", F.col("date").cast("string").alias("date"))


@query(R.using("snapshots") + "SELECT target, strftime(date, '%Y-%m-%d') AS date, score FROM snapshots WHERE target = 3 AND date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'")
def closed_time_range(spark, sf_dir):
    s = R.snapshots(spark, sf_dir).where("target = 3 and date between date '1999-01-01' and date '1999-12-31'")
    return s.select("target", F.col("date").cast("string").alias("date"), "score")


@query(R.using("snapshots") + ", t AS (SELECT target, sum(score) AS total FROM snapshots GROUP BY 1) SELECT n_regionkey::BIGINT AS region, target, round(total / sum(total) OVER (PARTITION BY n_regionkey), 6) AS share FROM t JOIN nation ON n_nationkey = target")
def share_of_total(spark, sf_dir):
    t = R.snapshots(spark, sf_dir).groupBy("target").agg(F.sum("score").alias("total"))
    n = R.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("target"), F.col("n_regionkey").cast("long").alias("region"))
    return series.share(t.join(n, "target"), "region", "total").select("region", "target", "share")


@query("SELECT p_partkey AS id, round(CASE WHEN max(p_retailprice) OVER () = min(p_retailprice) OVER () THEN 0.5 ELSE (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) END, 6) AS scaled FROM part")
def minmax_scale(spark, sf_dir):
    p = R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_retailprice")
    return series.minmax(p, "p_retailprice", "scaled").select("id", F.round("scaled", 6).alias("scaled"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, coalesce(CAST(sum(length(props)) AS BIGINT), 0) AS bytes FROM events")
def count_and_bytes(spark, sf_dir):
    return R.read(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("props")), F.lit(0)).alias("bytes"))


@query("SELECT o_orderpriority AS message, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def counts_pivoted(spark, sf_dir):
    o = R.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("message")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return o.na.fill(0, ["F", "O", "P"])


@query("SELECT o_orderpriority AS type, o_orderstatus AS visibility, count(*) AS n FROM orders GROUP BY ROLLUP (1, 2)")
def two_key_rollup(spark, sf_dir):
    return R.read(spark, sf_dir, "orders").rollup(F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("visibility")).agg(F.count(F.lit(1)).alias("n"))
