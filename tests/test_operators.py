"""Operators on hand-made tables: the edges that the supplied tables do not reach."""

import datetime as dt

from pyspark.sql import functions as F

from loam.functions import scoring
from loam.operators import churn, coupling, delta, docs, federation, graph, identity, impact, intervals, modules, ownership, search, series, usage


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_pagerank_keeps_dangling_mass_out_and_ignores_unknown_seeds(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(1,), (99,)], "id long")
    got = dict(rows(graph.pagerank(e, seeds, steps=20), "id", "score"))
    assert abs(got[1] - 0.15) < 1e-9 and abs(got[4] - 0.15 * 0.85**3) < 1e-9 and 99 not in got
    assert graph.pagerank(e, seeds.where("id > 100"), steps=3).count() == 0


def test_reach_stops_and_is_least(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1)], "src long, dst long")
    one = spark.createDataFrame([(1,)], "id long")
    assert rows(graph.reach(e, one, 5), "id", "depth") == [(1, 0), (2, 1), (3, 1)]
    assert rows(graph.reach(e, one, 0), "id", "depth") == [(1, 0)]


def test_strongest_way_stops_at_a_repeat(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 2, 0.5)], "src long, dst long, weight double")
    w = graph.strongest_way(e, spark.createDataFrame([(2,)], "id long"), spark.createDataFrame([(9,)], "id long"), 5)
    assert [list(r["way"]) for r in w.collect()] == [[2, 1]]


def test_innermost_interval_with_nested_and_equal_spans(spark):
    defs = spark.createDataFrame([("d", 1, 0, 300), ("d", 2, 10, 20), ("d", 3, 10, 20), ("d", 4, 100, 140)], "doc string, id long, start long, end long")
    points = spark.createDataFrame([("d", 1, 15), ("d", 2, 130), ("d", 3, 250), ("d", 4, 400), ("x", 5, 15)], "doc string, pid long, line long")
    assert rows(intervals.innermost(points, defs), "pid", "id") == [(1, 2), (2, 4), (3, 1)]


def test_enclosing_needs_a_start_before(spark):
    defs = spark.createDataFrame([("d", 1, 10), ("d", 2, 20)], "doc string, id long, start long")
    points = spark.createDataFrame([("d", 1, 5), ("d", 2, 10), ("d", 3, 25)], "doc string, pid long, line long")
    assert rows(intervals.enclosing(points, defs), "pid", "id") == [(2, 1), (3, 2)]
    assert rows(intervals.close(defs), "id", "end") == [(1, 19), (2, 520)]


def test_tiered_match_all_tiers(spark):
    s = spark.createDataFrame([(1, "f", "a.go", "n", 3), (2, "g", "a.go", "n", 4), (3, "g", "b.go", "n", 5), (4, "h", "b.go", "m", 6)], "symbol_id long, name string, file string, namespace string, line int")
    c = spark.createDataFrame([(1, "f", "a.go", "n", 3), (2, "g", "a.go", "n", 9), (3, "g", "z", "n", 9), (4, "f", "z", "n", 9), (5, "h", "z", "q", 1), (6, "none", "z", "q", 1)], "call_id long, name string, file string, namespace string, line int")
    got = {r["call_id"]: (r["symbol_id"], r["quality"], r["confidence"]) for r in usage.tiered_match(c, s).collect()}
    assert got == {1: (1, "exact", 0.95), 2: (2, "strong", 0.85), 3: (None, "unmatched", 0.0), 4: (1, "weak", 0.6), 5: (4, "weak", 0.5), 6: (None, "unmatched", 0.0)}


def test_rules_last_wins_and_negation_clears(spark):
    rules = ownership.parse_rules("# all\n* @a\n/src/ @b @c\n*.md d@x\n!/src/gen/\ndocs/**/x.txt @e\n")
    paths = spark.createDataFrame([("main.go",), ("src/a.go",), ("src/r.md",), ("src/gen/z.go",), ("docs/a/b/x.txt",), ("lib/src/q.go",)], "path string")
    got = {r["path"]: r["owners"] for r in ownership.last_match(paths, rules).collect()}
    assert got == {"main.go": ["@a"], "src/a.go": ["@b", "@c"], "src/r.md": ["d@x"], "src/gen/z.go": None, "docs/a/b/x.txt": ["@e"], "lib/src/q.go": ["@a"]}


def test_trend_edges(spark):
    d = dt.date
    p = spark.createDataFrame([("one", d(2024, 1, 1), 3.0), ("same", d(2024, 1, 1), 3.0), ("same", d(2024, 1, 1), 9.0), ("down", d(2024, 1, 1), 10.0), ("down", d(2024, 1, 11), 0.0)], "target string, date date, score double")
    got = {r["target"]: (r["slope"], r["direction"], r["projection"]) for r in series.trend(p).collect()}
    assert got["one"] == (0.0, "stable", 3.0) and got["same"][:2] == (0.0, "stable") and got["down"] == (-1.0, "decreasing", 0.0)


def test_minmax_of_a_constant_is_one_half(spark):
    assert rows(series.minmax(spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, v double"), "v", "s"), "id", "s") == [(1, 0.5), (2, 0.5)]


def test_changes_with_and_without_an_old_key(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "path string, v int")
    ch = spark.createDataFrame([("a", 9, "M", None), ("b", None, "D", None), ("c2", 3, "R", "c"), ("d", 8, "R", None), ("e", 5, "A", None)], "path string, v int, op string, old_key string")
    assert rows(delta.apply_changes(base, ch, "path"), "path", "v") == [("a", 9), ("c2", 3), ("d", 8), ("e", 5)]


def test_table_hash_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    h = lambda df: delta.table_hash(delta.hashed(df, ["k"], ["k", "v"])).first()["snapshot"]
    assert h(a) == h(a.orderBy(F.desc("k"))) != h(a.withColumn("v", F.lit("z")))


def test_alias_chains(spark):
    al = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (7, 8), (8, 7)], "old long, new long")
    ids = spark.createDataFrame([(1,), (4,), (7,), (9,)], "id long")
    got = {r["id"]: (r["target"], r["hops"], r["cycle"]) for r in identity.resolve_aliases(ids, al).collect()}
    assert got == {1: (4, 3, False), 4: (5, 1, False), 7: (7, 2, True), 9: (9, 0, False)}


def test_reconcile_queries_read_the_whole_table(spark, tmp_path):
    from loam.plans import change

    parts = [(i, f"name {i}", "T", "B", i % 50) for i in range(1, 2101)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    gone = {i for i in range(1, 2101) if i % 5 == 1}
    assert {r["old_id"] for r in change.fuzzy_alias(spark, str(tmp_path)).collect()} == gone
    back = {(i % 11 + i % 2) for i in range(1, 2101) if i % 5 == 0}
    assert {r["old_id"] for r in change.renamed_by_backend(spark, str(tmp_path)).collect()} == {i for i in gone if i % 11 in back}


def test_reconcile_finds_the_best_of_all_new_symbols(spark):
    import random

    r = random.Random(7)
    names = ["run", "_run", "Run", "ru_n", "rung", "stop", "", "a", "b", "walk_all", "Walkall", None]
    some = lambda k, n: [(f"{k}{i:03}", f"{k}{i}", r.choice("fmt"), r.choice(names), r.choice(["p.a", "p.b", "q", "", None]), r.choice(["u/v", "u/w", "v", None, ""])) for i in range(n)]
    old, new = [*some("o", 200), ("ox", "ox", "f", "only", "c", "p")], [*some("n", 12), ("nx", "nx", "m", "only", "c", "p")]

    def score(o, n):
        plain = lambda x: x.replace("_", "").lower()
        (ok, on, oc, op), (nk, nn, nc, np_) = ((x[2] or "", x[3] or "", x[4] or "", x[5]) for x in (o, n))
        name = 0.4 if on == nn else 0.2 if plain(on) == plain(nn) else 0
        box = 0.2 if oc == nc else 0.1 if oc and nc and oc.split(".")[0] == nc.split(".")[0] else 0
        folder = lambda p: p[: p.rfind("/") + 1]
        path = 0 if op is None or np_ is None else 0.1 if op == np_ else 0.05 if folder(op) == folder(np_) else 0
        return round(0.3 * (ok == nk) + name + box + path, 6)

    def best(o):
        found = [(-score(o, n), n[0]) for n in new if score(o, n) >= 0.6]
        return (min(found)[1], -min(found)[0], "similar") if found else (None, 0.0, "deleted")

    cols = "sid string, backend string, kind string, name string, container string, path string"
    got = {x["old_id"]: (x["new_id"], x["confidence"], x["reason"]) for x in identity.reconcile(spark.createDataFrame(old, cols), spark.createDataFrame(new, cols)).collect()}
    assert got == {o[0]: best(o) for o in old} and got["ox"] == ("nx", 0.7, "similar")
    assert {"similar", "deleted"} == {x[2] for x in got.values()}


def test_periods(spark):
    t = spark.createDataFrame([(dt.datetime(2024, 12, 30),), (dt.datetime(2024, 2, 29, 23, 59),), (None,)], "ts timestamp")
    got = t.select(*[scoring.period(F.col("ts"), k).alias(k) for k in ("daily", "weekly", "monthly")]).collect()
    assert [tuple(r) for r in got] == [("2024-12-30", "2025-W01", "2024-12"), ("2024-02-29", "2024-W09", "2024-02"), (None, None, None)]


def test_half_trend_edges(spark):
    d = spark.createDataFrame([("one", 1, 5), ("up", 1, 0), ("up", 2, 3), ("flat", 1, 4), ("flat", 2, 4), ("none", 1, 0), ("none", 2, 0)], "k string, d int, n long")
    got = {r["k"]: r["trend"] for r in usage.half_trend(d, "k", "d", "n").collect()}
    assert got == {"one": "stable", "up": "increasing", "flat": "stable", "none": "stable"}


def test_upserts_treat_null_keys_as_equal(spark):
    s = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, j string, n long")
    b = spark.createDataFrame([("a", None, 5), ("a", None, 1), ("c", "y", 7)], "k string, j string, n long")
    assert sorted((r["k"], r["j"] or "", r["n"]) for r in usage.upsert_add(s, b, ["k", "j"], ["n"]).collect()) == [("a", "", 7), ("b", "x", 2), ("c", "y", 7)]


def test_mentions_skip_fences_and_resolve(spark):
    text = "see `a.b` `x`\n```go\nq := pkg.New() `in.it`\nq.Go(pkg.New)\n```\nand `pkg::T` `read.md`\n~~~\nm.n\n```\n~~~\n<!-- t:symbol s.t --> <!-- t:known_symbols T, Go -->\n```\nopen.end"
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = rows(docs.mentions(d, "id", "text"), "line", "mention", "method", "known")
    fences = [(2, "in.it", "fence", False), (2, "pkg.New", "fence", False), (2, "q.Go", "fence", True), (7, "m.n", "fence", False)]
    assert got == sorted([(1, "a.b", "backtick", False), (3, "in.it", "backtick", False), *fences, (6, "pkg::T", "backtick", True), (11, "s.t", "directive", True)])
    k = spark.createDataFrame([(1, "Go", True, "directive"), (2, "Go", False, "directive"), (3, "q.Go", False, "fence")], "mid long, mention string, known boolean, method string")
    one = spark.createDataFrame([(5, "p.q.Go")], "symbol_id long, name string")
    assert rows(docs.resolve(k, one), "mid", "symbol_id", "status", "confidence") == [(1, 5, "suffix", 0.85), (2, None, "ineligible", 0.0), (3, 5, "suffix", 0.665)]
    s = spark.createDataFrame([(1, "q.pkg.T.m"), (2, "z.a.b"), (3, "y.a.b")], "symbol_id long, name string")
    m = spark.createDataFrame([(1, "pkg.T.m"), (2, "a.b"), (3, "x"), (4, "no.way"), (5, "z.a.b")], "mid long, mention string")
    assert rows(docs.resolve(m, s), "mid", "status") == [(1, "suffix"), (2, "ambiguous"), (3, "ineligible"), (4, "missing"), (5, "exact")]


def test_longest_prefix_goes_by_segments(spark):
    f = spark.createDataFrame([("src/ab/c.go",), ("src/a/c.go",), ("x.go",)], "path string")
    r = spark.createDataFrame([("src", "root"), ("src/a", "a")], "root string, module string")
    assert rows(modules.longest_prefix(f, r), "path", "module") == [("src/a/c.go", "a"), ("src/ab/c.go", "root")]


def test_co_changes_count_repeats_once(spark):
    c = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "commit_id long, path string")
    assert rows(coupling.co_changes(c), "path", "other", "together", "changes") == [("a", "b", 1, 2), ("b", "a", 1, 1)]


def test_partners_by_pairs_and_by_bitmaps(spark):
    import random

    r = random.Random(2)
    e = sorted({(r.randint(0, 70_000), r.randint(0, 40)) for _ in range(400)} | {(c, 99) for c in range(0, 300, 3)} | {(80_000, 7777)})
    near = {c: {b for b, k in e for a, m in e if a == c and m == k and b != c} for c in {c for c, _ in e}}
    df = spark.createDataFrame(e, "contract long, consumer long")
    for hot in (0, 20, 1000):
        got = {x["contract"]: x["partners"] for x in federation.partners(df, hot).collect()}
        assert got == {c: len(v) for c, v in near.items() if v}


def test_mean_confidence_rounds_halves_up(spark):
    d = spark.createDataFrame([(545, 640), (0, 3), (95, 1), (1, 3)], "s long, n long")
    assert [x[0] for x in d.select(impact.mean_confidence(F.col("s"), F.col("n"))).collect()] == [0.008516, 0.0, 0.95, 0.003333]


def test_co_changes_count_every_commit_whatever_its_size(spark):
    c = spark.createDataFrame([(1, "f0"), (1, "f1"), (2, "f0"), *[(3, f"f{i}") for i in range(250)]], "commit_id long, path string")
    got = {(r["path"], r["other"]): (r["together"], r["changes"]) for r in coupling.co_changes(c).collect()}
    assert len(got) == 250 * 249 and got["f0", "f1"] == (2, 3) and got["f1", "f0"] == (2, 2) and got["f249", "f0"] == (1, 1)
    one = coupling.co_changes(c, spark.createDataFrame([("f0",)], "path string"))
    assert {r["other"]: r["together"] for r in one.collect()} == {b: n for (a, b), (n, _) in got.items() if a == "f0"}


def test_empty_tables_give_empty_results(spark):
    c = spark.createDataFrame([], "commit_id long, path string, author long, ts timestamp, additions long, deletions long")
    assert churn.file_churn(c).count() == 0 and coupling.co_changes(c).count() == 0
    t = spark.createDataFrame([], "id long, text string")
    assert search.postings(t, "id", "text").count() == 0


def test_reconcile_tombstones(spark):
    cols = "sid string, backend string, kind string, name string, container string, path string"
    old = spark.createDataFrame([("1", "b1", "f", "load", "C", "p"), ("2", "b2", "f", "save", "C", "p"), ("3", "b3", "t", "Zed", "C", "p")], cols)
    new = spark.createDataFrame([("9", "b1", "f", "loadAll", "C", "p"), ("8", "bx", "f", "saves", "C", "p")], cols)
    got = {r["old_id"]: (r["new_id"], r["reason"]) for r in identity.reconcile(old, new).collect()}
    assert got == {"1": ("9", "renamed"), "2": ("8", "similar"), "3": (None, "deleted")}


def test_one_document_of_all_rows_spreads_over_ranges(spark):
    """The last definition and the next start are carried from range to range."""
    import bisect
    import random

    from loam.operators import intervals

    rng = random.Random(8)
    starts = sorted(rng.sample(range(100, 20_000), 300))
    defs = [("big", s, i) for i, s in enumerate(starts)] + [("big", starts[5], 900), ("small", 7, 901), ("none", 50, 902)]
    points = [("big", rng.randrange(25_000), p) for p in range(2_000)] + [("small", 6, 5_000), ("small", 7, 5_001), ("none", 3, 5_002), ("other", 1, 5_003)]
    d = spark.createDataFrame(defs, "doc string, start long, id long")
    p = spark.createDataFrame(points, "doc string, line long, pid long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table would be one range
    assert intervals._in_ranges(d, "start", "id").where("doc = 'big'").select("part").distinct().count() > 1
    by = {x: sorted((s, i) for doc, s, i in defs if doc == x) for x in ("big", "small", "none", "other")}
    want = {}
    for doc, line, pid in points:
        at = bisect.bisect_right(by[doc], (line, 10**9))
        if at:
            want[pid] = by[doc][at - 1][1]
    assert {r["pid"]: r["id"] for r in intervals.enclosing(p, d).collect()} == want
    ends = {r["id"]: r["end"] for r in intervals.close(d, 500).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ends == {i: (x[k + 1][0] - 1 if k + 1 < len(x) else s + 500) for x in by.values() for k, (s, i) in enumerate(x)}
