"""Schedules, caches, cursors and other service state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loam.operators import graph, service


@pytest.mark.parametrize(
    ("expression", "after", "want"),
    [
        ("every 90m", "2024-01-31 23:00", "2024-02-01 00:30"),
        ("Every 2 Days", "2024-02-28 05:00", "2024-03-01 05:00"),
        ("every 59s", "2024-01-01 00:00", None),
        ("daily at 7:05", "2024-01-01 07:05", "2024-01-02 07:05"),
        ("daily at 24:00", "2024-01-01 07:05", None),
        ("0,30 */6 * * *", "2024-01-01 00:00", "2024-01-01 00:30"),
        ("0,30 */6 * * *", "2024-01-01 18:30", "2024-01-02 00:00"),
        ("5 10-14/2 29 2 7", "2024-01-01 00:00", None),
        ("5 10-14/2 29 2 6", "2024-01-01 00:00", "2024-02-03 10:05"),
        ("0 0 31 4 0", "2024-04-28 00:00", "2025-04-06 00:00"),
        ("0 0 30 2 0", "2024-02-25 01:00", "2025-02-02 00:00"),
        ("1 1 1 1", "2024-01-01 00:00", None),
        ("", "2024-01-01 00:00", None),
    ],
)
def test_next_run(spark, expression, after, want):
    df = spark.createDataFrame([(expression, dt.datetime.fromisoformat(after))], "expression string, t timestamp")
    got = service.next_run(df, "t").first()["next"]
    assert got == (dt.datetime.fromisoformat(want) if want else None)


def test_cron_against_every_minute(spark):
    def allowed(field, low, high):
        out = set()
        for p in field.split(","):
            body, _, step = p.partition("/")
            a, b = (low, high) if body == "*" else tuple(map(int, body.split("-"))) if "-" in body else (int(body), int(body))
            out |= set(range(a, b + 1, int(step or 1)))
        return out

    rows, want = [], {}
    for i, e in enumerate(("*/17 3,22 * 5 *", "59 23 31 12 1", "7 0-5 1-3 * 2", "0 12 15 1-6/2 5,6", "30 6 13 * 5")):
        for day in (dt.datetime(2023, 12, 31, 23, 58), dt.datetime(2024, 2, 28, 12, 0), dt.datetime(2024, 6, 1, 6, 30)):
            f = [allowed(x, a, b) for x, (a, b) in zip(e.split(), ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6)), strict=True)]
            t = day + dt.timedelta(minutes=1)
            while not (t.minute in f[0] and t.hour in f[1] and t.month in f[3] and (t.day in f[2] or t.isoweekday() % 7 in f[4])):
                t += dt.timedelta(minutes=1)
            rows.append((len(rows), e, day))
            want[len(rows) - 1] = t
    df = spark.createDataFrame(rows, "i int, expression string, t timestamp")
    assert {r["i"]: r["next"] for r in service.next_run(df, "t").collect()} == want


def test_cursors_round_trip_and_reject(spark):
    df = spark.createDataFrame([("core", 15, "abc"), ("é?>", 0, "/+"), ("x", 7, "h")], "p string, o long, h string").withColumn("c", service.page_cursor(F.col("p"), F.col("o"), F.col("h")))
    got = df.select(service.read_cursor(F.col("c"), F.col("p"), F.col("h")).alias("a"), service.read_cursor(F.col("c"), F.col("p"), F.lit("new")).alias("b"), service.read_cursor(F.lit(""), F.col("p"), F.col("h")).alias("d"), service.read_cursor(F.lit("%%%"), F.col("p"), F.col("h")).alias("e"), "c").collect()
    assert [(r["a"], r["b"], r["d"], r["e"]) for r in got] == [(15, None, 0, None), (0, None, 0, None), (7, None, 0, None)]
    assert not any(set(r["c"]) & set("+/=") for r in got)


def test_cache_replaces_expires_and_drops(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    e = spark.createDataFrame([("k", "s1", "old", t(0)), ("k", "s2", "new", t(5)), ("j", "s1", "x", t(1))], "key string, state string, value string, created timestamp")
    c = service.cache_put(e.limit(0).withColumn("expires", F.col("created")), e, F.lit(600))
    assert c.count() == 2
    wanted = spark.createDataFrame([("k", "s1"), ("k", "s2"), ("j", "s1"), ("z", "s1")], "key string, state string")
    at = lambda m: {(r["key"], r["state"]): r["value"] for r in service.cache_get(c, wanted, F.lit(t(m))).collect() if r["hit"]}
    assert at(11) == {("k", "s2"): "new", ("j", "s1"): "x"} and at(12) == {("k", "s2"): "new"} and at(30) == {}
    assert [r["key"] for r in service.cache_drop(c, spark.createDataFrame([("s2",)], "state string"), F.lit(t(2))).collect()] == ["j"]


def test_decisions_and_states(spark):
    ids = lambda n: spark.range(n)
    said = lambda a, b: service.refresh_decision(ids(a), ids(b)).first()["decision"]
    assert [said(0, 10), said(5, 10), said(51, 100), said(50, 100), said(3, 0)] == ["unchanged", "incremental", "full", "incremental", "incremental"]
    meta = spark.createDataFrame([("a", "state", "full"), ("a", "dirty", "true"), ("b", "state", "partial"), ("c", "dirty", "true")], "repo string, key string, value string")
    got = {r["repo"]: (r["state"], r["pending"]) for r in service.index_state(meta, spark.createDataFrame([("b",), ("b",)], "repo string")).collect()}
    assert got == {"a": ("full_dirty", 0), "b": ("pending", 2), "c": ("unknown", 0)}


def test_call_graph_and_paths(spark):
    e = spark.createDataFrame([(1, 2, 5), (2, 3, 1), (1, 3, 2), (3, 1, 1), (9, 1, 4), (8, 9, 1), (3, 4, 7)], "src long, dst long, weight long")
    got = sorted(tuple(r) for r in graph.call_graph(e, 1, 2).collect())
    assert got == [(1, "root", 0, 0), (2, "callee", 1, 5), (2, "caller", 2, 1), (3, "callee", 1, 2), (3, "caller", 1, 1), (4, "callee", 2, 7), (8, "caller", 2, 1), (9, "caller", 1, 4)]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    found = graph.paths_between(e, ids(8, 1), ids(4, 9), 4, 1)
    assert sorted((r["source"], r["target"], list(r["path"])) for r in found.collect()) == [(1, 4, [1, 3, 4]), (8, 9, [8, 9])]


def test_way_back_goes_past_visited_vertices_and_stops_at_a_seed(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 9.0), (3, 2, 9.0), (1, 3, 1.0), (5, 1, 2.0), (6, 5, 2.0)], "src long, dst long, weight double")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    got = {r["target"]: list(r["way"]) for r in graph.strongest_way(e, ids(3, 5, 6), ids(5), 5).collect()}
    assert got == {3: [3, 2, 1, 5], 5: [5], 6: [6]}


def test_pagerank_ends_early_when_nothing_moves(spark):
    e = spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, weight double")
    got = {r["id"]: r["score"] for r in graph.pagerank(e, spark.createDataFrame([(1,)], "id long"), steps=50).collect()}
    assert abs(got[1] - 0.15) < 1e-12 and abs(got[2] - 0.1275) < 1e-12


def test_http_pages_and_signatures(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from loam.operators import jobs

    class Member(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            more = "cursor=two" in self.path
            self.send_response(500 if self.path.startswith("/bad") else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"rows": [{"id": 2 if more else 1}], "next": None if more else "two"}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Member)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    m = spark.createDataFrame([("a", f"{at}/x?y=1"), ("b", f"{at}/bad")], "repo string, address string")
    got = jobs.remote_rows(m, jobs.http_page, "id long").collect()
    from loam.sources import remote

    remote.register(spark)
    source = spark.read.format("loam-remote").option("addresses", f"a={at}/x?y=1 c={at}/z").load()
    assert sorted((r["repo"], json.loads(r["body"])["id"]) for r in source.collect()) == [("a", 1), ("a", 2), ("c", 1), ("c", 2)]
    server.shutdown()
    assert sorted((r["repo"], r["row"]["id"] if r["row"] else None, bool(r["error"])) for r in got) == [("a", 1, False), ("a", 2, False), ("b", None, True)]
    assert jobs.sign(b"key", b"The quick brown fox jumps over the lazy dog") == "f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8"
    assert {r["worker"] for r in jobs.assigned(spark.range(100), 4).collect()} == {0, 1, 2, 3}


def test_signed_cursors(spark):
    """As the standard library signs; forged, foreign and broken ones are refused, none is the first page."""
    import base64
    import hashlib
    import hmac
    import json

    secret = b"s" * 70
    url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    def made(data, key=secret):
        body = json.dumps(data, separators=(",", ":")).encode()
        return f"{url(body)}.{url(hmac.new(key, body, hashlib.sha256).digest())}"
    keys = ["scip go pkg Foo#", "ü/1", "", None]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r["c"] for r in df.select(service.signed_cursor(F.lit("symbol"), F.col("k"), secret).alias("c")).collect()]
    assert [json.loads(base64.urlsafe_b64decode(c.split(".")[0] + "==")) for c in got] == [{"e": "symbol", "pk": k} if k else {"e": "symbol"} for k in keys]
    assert got[0] == made({"e": "symbol", "pk": keys[0]})
    good = made({"e": "symbol", "pk": "x"})
    cursors = [*got, "", None, good, good[:-2] + "zz", "A" + good, made({"e": "file", "pk": "x"}), made({"e": "symbol", "pk": "x"}, b"other"), "nodot", "....", "é.é"]
    read = [r["k"] for r in spark.createDataFrame([(c,) for c in cursors], "c string").select(service.read_signed_cursor(F.col("c"), F.lit("symbol"), secret).alias("k")).collect()]
    assert read == ["scip go pkg Foo#", "ü/1", "", "", "", "", "x", *[None] * 7]
