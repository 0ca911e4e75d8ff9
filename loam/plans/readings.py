"""Queries that read text formats and write tables. The texts are made of the supplied tables' rows, so their fields are known."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions.shared import shared_dir
from loam.operators import listing
from loam.plans.catalog import query
from loam.sources import index_format, readers, source_code, writers
from loam.sources import relations as R
from loam.streaming import expiring
from loam.streaming import usage as streams


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/loam-{name}-{uuid.uuid4().hex}"


# -- decision records ------------------------------------------------------------------------------------------------------


def _records(spark, sf_dir):
    """A decision record a part, as Markdown."""
    day = F.concat(F.lit("2024-03-"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0"))
    text = F.concat(F.lit("# ADR-"), F.col("p_partkey").cast("string"), F.lit(": "), "p_name", F.lit("\n\n**Status:** "), F.when(F.col("p_size") % 2 == 0, "Accepted").otherwise("Proposed"), F.lit("\n**Date:** "), day, F.lit("\n\n## Context\n"), "p_type", F.lit("\n\n## Decision\nuse "), "p_brand", F.lit("\n\n## Consequences\n- "), "p_name", F.lit("\n- "), "p_type", F.lit("\n\n## Affected Modules\n* "), "p_brand", F.lit("\n"))
    return readers.adr(R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), text.alias("text")))


_ADR = "a AS (SELECT p_partkey AS path, 'ADR-' || CASE WHEN p_partkey < 100 THEN lpad(p_partkey::VARCHAR, 3, '0') ELSE p_partkey::VARCHAR END AS id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'accepted' ELSE 'proposed' END AS status, DATE '2024-03-01' + CAST(p_partkey % 28 AS INT) AS date, p_type AS context, 'use ' || p_brand AS decision, p_name || '|' || p_type AS consequences, p_brand AS affected FROM part)"


@query(f"WITH {_ADR} SELECT path, id, title, status, strftime(date, '%Y-%m-%d') AS date, context, decision, consequences, affected FROM a")
def adr_records(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.select("path", "id", "title", "status", F.date_format("date", "yyyy-MM-dd").alias("date"), "context", "decision", F.array_join("consequences", "|").alias("consequences"), F.array_join("affected_modules", "|").alias("affected"))


@query("SELECT CAST(max(p_partkey) + 1 AS INT) AS next FROM part")
def adr_next(spark, sf_dir):
    return readers.next_adr(_records(spark, sf_dir))


@query(f"WITH {_ADR} SELECT id, '# ' || id || ': ' || title || chr(10) || chr(10) || '**Status:** ' || status || chr(10) || '**Date:** ' || strftime(date, '%Y-%m-%d') || chr(10) || chr(10) || '## Context' || chr(10) || context || chr(10) || chr(10) || '## Decision' || chr(10) || decision || chr(10) || chr(10) || '## Consequences' || chr(10) || '- ' || replace(consequences, '|', chr(10) || '- ') || chr(10) || chr(10) || '## Affected Modules' || chr(10) || '- ' || affected || chr(10) AS text FROM a")
def adr_render(spark, sf_dir):
    return readers.render_adr(_records(spark, sf_dir))


# -- declarations, files, telemetry, contracts ----------------------------------------------------------------------------------

_TOML = "".join(f'[[module]]\nname = "m{i}"\nroot = "src/m{i}"\nowner = "team{i % 3}"\ntags = ["t{i % 2}", "all"]\n' for i in range(1, 9))


@query("SELECT 'm' || i AS name, 'src/m' || i AS root, 'team' || (i % 3) AS owner, 't' || (i % 2) || ',all' AS tags FROM range(1, 9) r(i)")
def toml_modules(spark, sf_dir):
    return readers.declared_modules(spark, _TOML).withColumn("tags", F.array_join("tags", ","))


@query("SELECT doc_id AS path, octet_length(encode(coalesce(text, ''))) AS bytes, sha256(coalesce(text, '')) AS hash FROM documents")
def content_hashes(spark, sf_dir):
    return readers.hashed_texts(R.read(spark, sf_dir, "documents"), "doc_id", "text")


@query("WITH a AS (SELECT p_partkey AS path, p_name AS v FROM part WHERE p_size > 5), b AS (SELECT p_partkey AS path, CASE WHEN p_size > 40 THEN p_brand ELSE p_name END AS v FROM part WHERE p_size < 45) SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.v <> b.v")
def polled_changes(spark, sf_dir):
    """What a poll finds between two listings of a directory."""
    p = R.read(spark, sf_dir, "part")
    now = p.where("p_size < 45").withColumn("v", F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise(F.col("p_name")))
    return readers.changed_files(readers.hashed_texts(p.where("p_size > 5"), "p_partkey", "p_name"), readers.hashed_texts(now, "p_partkey", "v"))


@query("SELECT 's' || user_id AS service, event_type AS function, CASE WHEN event_id % 2 = 0 THEN 'f' || (event_id % 9) ELSE 'n' || (event_id % 4) END AS origin, count(*) AS rows, CAST(sum(event_id % 5) AS BIGINT) AS calls FROM events GROUP BY 1, 2, 3")
def telemetry_bodies(spark, sf_dir):
    """Call aggregates from JSON bodies; every other one lacks the file and falls back to its namespace."""
    e = R.read(spark, sf_dir, "events")
    file = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("f"), (F.col("event_id") % 9).cast("string")))
    one = F.struct(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("service_name"), F.col("event_type").alias("function_name"), F.concat(F.lit("n"), (F.col("event_id") % 4).cast("string")).alias("namespace"), file.alias("file_path"), (F.col("event_id") % 5).alias("call_count"))
    t = readers.telemetry(e.select(F.to_json(F.struct(F.array(one).alias("calls"))).alias("body")))
    return t.groupBy(F.col("service_name").alias("service"), F.col("function_name").alias("function"), "origin").agg(F.count(F.lit(1)).alias("rows"), F.sum("call_count").alias("calls"))


@query("SELECT 's' || user_id AS service, CASE WHEN event_id % 3 = 0 THEN 'route' ELSE event_type END AS function, CAST(sum(event_id % 5) AS BIGINT) AS calls FROM events GROUP BY 1, 2")
def metric_points(spark, sf_dir):
    """Calls from metric points; a third of them name their function by a later attribute, as the first is empty."""
    value = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    name = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))
    point = F.struct(F.array(value("code.function", name), value("http.route", F.lit("route"))).alias("attributes"), (F.col("event_id") % 5).cast("string").alias("asInt"))
    metric = F.struct(F.lit("calls").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("sum"))
    resource = F.struct(F.struct(F.array(value("service.name", F.concat(F.lit("s"), F.col("user_id").cast("string")))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))
    return readers.otlp(R.read(spark, sf_dir, "events").select(F.to_json(F.struct(F.array(resource).alias("resourceMetrics"))).alias("body")))


_WORD = "replace(p_name, ' ', '_')"


@query(f"SELECT p_partkey AS path, 'x.' || {_WORD} AS package, 'S' || p_partkey AS services, 'M' || p_size || '|N' AS messages, lower(p_type) || '.proto' AS imports FROM part")
def proto_contracts(spark, sf_dir):
    word, key = F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string")
    text = F.concat(F.lit('syntax = "proto3";\npackage x.'), word, F.lit(';\nimport "'), F.lower("p_type"), F.lit('.proto";\nservice S'), key, F.lit(" {}\nmessage M"), F.col("p_size").cast("string"), F.lit(" {}\nmessage N {}\n"))
    files = R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), text.alias("text"))
    joined = lambda c: F.array_join(c, "|").alias(c)
    return readers.proto_contract(files).select("path", "package", joined("services"), joined("messages"), joined("imports"))


@query(f"SELECT p_partkey AS path, CASE WHEN p_partkey % 3 < 2 THEN '3.0.' || p_size END AS version, CASE WHEN p_partkey % 3 < 2 THEN '/' || {_WORD} || '|/b/{{id}}' END AS paths FROM part")
def api_contracts(spark, sf_dir):
    """API descriptions in JSON and YAML, and texts that are none."""
    word, size = F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.col("p_size").cast("string")
    json = F.concat(F.lit('{"openapi": "3.0.'), size, F.lit('", "paths": {"/'), word, F.lit('": {}, "/b/{id}": {}}}'))
    yaml = F.concat(F.lit("openapi: 3.0."), size, F.lit("\ninfo:\n  title: x\npaths:\n  /"), word, F.lit(":\n    get:\n      /no: 1\n  /b/{id}:\n    post: {}\ncomponents:\n  /x: 1\n"))
    third = F.col("p_partkey") % 3
    files = R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.when(third == 0, json).when(third == 1, yaml).otherwise(F.col("p_name")).alias("text"))
    return readers.openapi_contract(files).withColumn("paths", F.array_join("paths", "|"))


# -- symbol index ----------------------------------------------------------------------------------------------------------------


def _documents(spark, sf_dir):
    """An index document an order: its lines are occurrences, its parts symbols that relate to the next part."""
    li = R.read(spark, sf_dir, "lineitem")
    symbol = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    start, end = F.col("l_linenumber") * 10, F.col("l_quantity").cast("int")
    place = F.when(F.col("l_linenumber") % 2 == 0, F.array(start, F.lit(0), end)).otherwise(F.array(start, F.lit(4), start + 2, end))
    occurrence = F.struct(place.alias("range"), symbol.alias("symbol"), F.when(F.col("l_returnflag") == "A", 1).otherwise(8).alias("roles"), F.lit(None).cast("array<int>").alias("enclosing"))
    related = F.struct(F.concat(F.lit("p"), (F.col("l_partkey") + 1).cast("string")).alias("symbol"), (F.col("l_linestatus") == "F").alias("reference"), (F.col("l_linestatus") == "O").alias("implementation"))
    about = F.struct(symbol.alias("symbol"), symbol.alias("name"), F.lit(12).alias("kind"), F.array().cast("array<string>").alias("docs"), F.array(related).alias("relationships"))
    return li.groupBy(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path")).agg(F.lit("go").alias("language"), F.sort_array(F.collect_list(occurrence)).alias("occurrences"), F.collect_list(about).alias("symbols"))


_OCC = "occ AS (SELECT 'o' || l_orderkey AS path, 'p' || l_partkey AS symbol, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 8 END AS roles, l_linenumber * 10 AS line, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 4 END AS start_col, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber * 10 ELSE l_linenumber * 10 + 2 END AS end_line, CAST(l_quantity AS INT) AS end_col FROM lineitem)"


@query(f"WITH {_OCC} SELECT * FROM occ")
def index_occurrences(spark, sf_dir):
    return readers.occurrences(_documents(spark, sf_dir))


@query(f"WITH {_OCC} SELECT DISTINCT path, line, start_col FROM occ WHERE symbol = 'p7' AND roles = 8 ORDER BY path, line, start_col LIMIT 100")
def index_references(spark, sf_dir):
    """References of one symbol, read from occurrences that are kept in the order of their symbols."""
    li = R.read(spark, sf_dir, "lineitem")
    start = F.col("l_linenumber") * 10
    even = F.col("l_linenumber") % 2 == 0
    rows = li.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("symbol"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(8).alias("roles"),
        start.alias("line"),
        F.when(even, 0).otherwise(4).alias("start_col"),
        F.when(even, start).otherwise(start + 2).alias("end_line"),
        F.col("l_quantity").cast("int").alias("end_col"),
    )
    kept = writers.clustered(li, rows, "occurrences", "symbol", "path")
    return readers.references(kept, "p7", definitions=False, limit=100).select("path", "line", "start_col")


@query(f"WITH {_OCC} SELECT path, symbol, count(*) AS n, CAST(sum(line + end_col) AS BIGINT) AS places FROM occ GROUP BY 1, 2")
def index_files(spark, sf_dir):
    """Occurrences from index files in their own wire format, which are written from the documents first."""
    docs = index_format.decode(index_format.encode(_documents(spark, sf_dir)))
    return readers.occurrences(docs).groupBy("path", "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("line") + F.col("end_col")).alias("places"))


@query("SELECT p_partkey::VARCHAR AS path, 'F' || p_size AS name, 3::INT AS line, CAST(CASE WHEN p_size % 2 = 0 THEN 9 ELSE 5 END AS INT) AS end_line, 'func F' || p_size || '(a int) int' AS signature, CAST(CASE WHEN p_size % 2 = 0 THEN 4 ELSE 1 END AS INT) AS cyclomatic, CAST(CASE WHEN p_size % 2 = 0 THEN 5 ELSE 0 END AS INT) AS cognitive FROM part")
def source_functions(spark, sf_dir):
    """Functions with their ranges, signatures and complexities, from source texts; every other one has a loop in a branch."""
    deep = '\n\tif a > 1 && "}" != "{" {\n\t\tfor i := 0; i < a; i++ { // if\n\t\t\ta--\n\t\t}\n\t}'
    text = F.concat(F.lit("package x\n\nfunc F"), F.col("p_size").cast("string"), F.lit("(a int) int {"), F.when(F.col("p_size") % 2 == 0, deep).otherwise("\n\ta++"), F.lit("\n}\n"))
    return source_code.functions(R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.lit("go").alias("language"), text.alias("text")))


@query("SELECT 'p' || l_partkey AS symbol, 'p' || (l_partkey + 1) AS related, l_linestatus = 'F' AS reference, l_linestatus = 'O' AS implementation FROM lineitem")
def symbol_relationships(spark, sf_dir):
    return readers.relationships(_documents(spark, sf_dir))


@query("SELECT p_partkey AS path, CAST(CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 3 = 1 THEN 2 ELSE 4 END AS INT) AS line, CASE WHEN p_size % 3 = 0 THEN p_name || chr(10) || p_brand WHEN p_size % 3 = 1 THEN p_name || chr(10) || p_brand || chr(10) || p_type ELSE p_type || chr(10) || 'end' END AS context FROM part")
def place_context(spark, sf_dir):
    """The lines around a place, at a text's start, middle and end."""
    p = R.read(spark, sf_dir, "part")
    files = p.select(F.col("p_partkey").alias("path"), F.concat_ws("\n", "p_name", "p_brand", "p_type", F.lit("end")).alias("text"))
    places = p.select(F.col("p_partkey").alias("path"), F.when(F.col("p_size") % 3 == 0, 1).when(F.col("p_size") % 3 == 1, 2).otherwise(4).alias("line"))
    return readers.context(files, places, 1)


@query("SELECT p_partkey AS id FROM part WHERE p_size > 25 AND p_type = 'PROMO' ORDER BY p_retailprice DESC, p_partkey LIMIT 40")
def predicate_closure(spark, sf_dir):
    """A listing whose conditions are given as values, some of them not."""
    p = R.read(spark, sf_dir, "part")
    return listing.listing(p, [F.col("p_size") > 25, None, F.col("p_type") == "PROMO"], [F.desc("p_retailprice"), "p_partkey"], 40).select(F.col("p_partkey").alias("id"))


# -- sinks -----------------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1")
def sink_full_refresh(spark, sf_dir):
    """A table that is written twice holds the second load only."""
    o, at = R.read(spark, sf_dir, "orders"), _folder(spark, "refresh")
    writers.overwrite(o, at, "o_orderstatus")
    writers.overwrite(o.where("o_orderkey % 2 = 1"), at, "o_orderstatus")
    return spark.read.parquet(at).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(R.using("snapshots") + "SELECT strftime(date, '%Y-%m-%d') AS day, count(*) AS n, round(sum(score), 2) AS total FROM snapshots WHERE date >= DATE '1998-01-01' GROUP BY 1")
def sink_series_retention(spark, sf_dir):
    """A series that grows by two loads, read back from its retention on: partitions before it are not read."""
    s, at = R.snapshots(spark, sf_dir).withColumn("snapshot_date", F.date_format("date", "yyyy-MM-dd")).drop("date"), _folder(spark, "series")
    writers.append_series(s.where("target < 10"), at)
    writers.append_series(s.where("target >= 10"), at)
    kept = spark.read.parquet(at).where(F.col("snapshot_date") >= F.lit("1998-01-01").cast("date"))
    return kept.groupBy(F.date_format("snapshot_date", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 2).alias("total"))


@query("WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ts FROM benchmark), p AS (SELECT item_id, len(ts) AS length, unnest(ts) AS term FROM t) SELECT term, item_id, length, count(*) AS tf FROM p WHERE term IN ('the', 'of', 'nothing_like_it') GROUP BY 1, 2, 3")
def index_lifecycle(spark, sf_dir):
    """An inverted index is built, rebuilt in its place and read for some terms."""
    from loam.operators import search

    postings, at = search.postings(R.read(spark, sf_dir, "benchmark"), "item_id", "text"), _folder(spark, "postings")
    writers.postings_table(postings.limit(5), at)
    writers.postings_table(postings, at)
    return writers.lookup_postings(spark, at, ["the", "of", "nothing_like_it"]).select("term", "item_id", "length", "tf")


@query("SELECT count(*) AS n, count(DISTINCT c_custkey) AS ids, round(sum(c_acctbal), 2) AS total FROM customer")
def rebuilt_table(spark, sf_dir):
    """A table of many small loads, rewritten into few files."""
    c, at, out = R.read(spark, sf_dir, "customer"), _folder(spark, "loads"), _folder(spark, "compact")
    c.repartition(8).write.parquet(at)
    writers.compact(spark, at, out, 2)
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("ids"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 7 > 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 8 > 0), d AS (SELECT coalesce(b.k, n.k) AS k, CASE WHEN b.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'deleted' WHEN b.s <> n.s THEN 'modified' END AS op FROM b FULL JOIN n ON b.k = n.k) SELECT k, op FROM d WHERE op IS NOT NULL")
def delta_artifacts(spark, sf_dir):
    """Differences written as JSON lines and read back."""
    from loam.plans.change import snapshot_diff

    at = _folder(spark, "delta")
    writers.delta_artifact(snapshot_diff(spark, sf_dir), at)
    return spark.read.schema("k long, op string").json(at)


@query("WITH p AS (SELECT page_id AS path, unnest(list_distinct(regexp_extract_all(html, '(?:href|src)=\"([^\"]+)\"', 1))) AS module FROM pages WHERE NOT contains(html, chr(0))) SELECT path, module FROM p")
def custom_imports(spark, sf_dir):
    """A language that a caller adds by its pattern: what pages link to and load."""
    p = R.read(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.lit("html").alias("language"), F.col("html").alias("text"))
    return readers.imports(p, {"html": r'(?:href|src)="([^"]+)"'})


# -- annotated files -------------------------------------------------------------------------------------------------------------


@query(
    "SELECT l_partkey AS path, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS line, 'User ' || o_custkey AS author, "
    "'u' || (o_custkey % 50) || '@x.org' AS email, strftime(o_orderdate, '%Y-%m-%d') AS day, l_returnflag || chr(9) || l_shipdate::DATE AS text FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
)
def blame_text(spark, sf_dir):
    """Annotated files in porcelain form, a part each: an order's first line in a file has its facts, its others a short header."""
    li = R.read(spark, sf_dir, "lineitem").join(R.read(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    place = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice"))
    nth = F.row_number().over(Window.partitionBy("l_partkey", "l_orderkey").orderBy("l_linenumber", "l_extendedprice"))
    commit, user = F.lpad(F.lower(F.hex("l_orderkey")), 40, "0"), F.col("o_custkey").cast("string")
    mail = F.concat(F.lit("u"), (F.col("o_custkey") % 50).cast("string"), F.lit("@x.org"))
    facts = F.concat(F.lit("author User "), user, F.lit("\nauthor-mail <"), mail, F.lit(">\nauthor-time "), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string"), F.lit("\nauthor-tz +0000\nsummary x\n"))
    rows = li.select("l_partkey", place.alias("line"), nth.alias("nth"), commit.alias("commit"), facts.alias("facts"), F.concat("l_returnflag", F.lit("\t"), F.col("l_shipdate").cast("date").cast("string")).alias("text"))
    entry = F.concat("commit", F.lit(" "), F.col("line").cast("string"), F.lit(" "), F.col("line").cast("string"), F.lit("\n"), F.when(F.col("nth") == 1, F.col("facts")).otherwise(F.lit("")), F.lit("\t"), "text")
    files = rows.groupBy(F.col("l_partkey").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", entry.alias("entry")))), lambda x: x["entry"]), "\n").alias("text"))
    return readers.blame(files).select("path", F.col("line").cast("long").alias("line"), "author", "email", F.date_format("ts", "yyyy-MM-dd").alias("day"), "text")


# -- streams ---------------------------------------------------------------------------------------------------------------------

_INGEST = "WITH e AS (SELECT event_type, strftime(ts, '%Y-%m') AS period, event_id FROM events)"


def _ingested(spark, sf_dir) -> tuple[str, str]:
    """Run the events through the stream, in micro-batches, late ones last; returns the tables of sums and of what matched nothing."""
    symbols = spark.createDataFrame([(1, "click"), (2, "view"), (3, "purchase")], "symbol_id long, name string")
    table, side, state = (_folder(spark, x) for x in ("usage", "quarantine", "progress"))
    streams.ingest(streams.read_events(spark, sf_dir), symbols, table, side, state).awaitTermination()
    return table, side


@query(_INGEST + " SELECT CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS symbol_id, period, count(*) AS calls FROM e WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2")
def stream_ingest(spark, sf_dir):
    """Usage by symbol and month, from a stream: sums merge whenever an event comes."""
    return streams.usage_state(spark, _ingested(spark, sf_dir)[0])


@query(_INGEST + " SELECT event_id, event_type AS function FROM e WHERE event_type NOT IN ('click', 'view', 'purchase')")
def stream_quarantine(spark, sf_dir):
    """The stream's side output: events that match no symbol."""
    return spark.read.parquet(_ingested(spark, sf_dir)[1]).select("event_id", "function")


@query(
    "SELECT event_type AS function, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS calls, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events"
    " GROUP BY 1, 2 HAVING min(date_trunc('day', ts)) + INTERVAL 11 DAY <= (SELECT max(ts) FROM events)"
)
def stream_retention(spark, sf_dir):
    """Usage by day from a stream that keeps a day for ten more days, gives its sums out and forgets them; days still kept are not there yet."""
    table, progress = _folder(spark, "closed"), _folder(spark, "progress")
    expiring.run_closed(spark, streams.read_events(spark, sf_dir).select("ts", "function", "k"), table, progress, "10 days")
    return spark.read.parquet(table).select("function", F.date_format("period", "yyyy-MM-dd").alias("day"), "calls", "k")
