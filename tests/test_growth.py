"""Values and shapes that only larger tables have."""

import random
import re
import string
import time

import duckdb
import pyarrow as pa

from loam.operators import delta, federation, graph, intervals, modules
from loam.plans import catalog
from loam.sources import search_store


def test_numbers_in_canonical_json(spark):
    """Without Java's exponents below 1e-3 and from 1e7, its 18 digits, and its decimal rounding of ties; as DuckDB writes them."""
    rows = [(0.0004286, "0.000429"), (12345678.9, "12345678.9"), (1e7, "10000000.0"), (0.0039085, "0.003908"), (0.00001, "1e-05"), (1e16, "1e+16"), (2.1588371374324467e17, "2.1588371374324467e+17"), (1e15 + 0.5, "1000000000000000.5"), (-1e-9, "-0.0"), (0.0, "0.0"), (2.5, "2.5"), (float("nan"), '"NaN"'), (None, None)]
    df = spark.createDataFrame([(i, 'a"b', x) for i, (x, _) in enumerate(rows)], "id long, n string, x double")
    got = dict(df.select("id", delta.canonical_json(df, "x", "n", "id")).collect())
    assert got == {i: f'{{"id":{i},"n":"a\\"b"' + (f',"x":{t}' if t else "") + "}" for i, (_, t) in enumerate(rows)}


def test_canonical_json_of_odd_customers_as_its_sql(spark, tmp_path):
    """A balance of -0.0 keeps its sign; customers without a name, a key or a balance that is due have no text."""
    rows = [(1, "a", 5, -0.0), (2, "b", 5, 0.0), (3, None, 5, 1.0), (4, "d", 5, None), (5, "e", 1, None), (6, "f", None, 2.0), (None, "g", 5, 7.0), (8, "h", 5, -1e-9), (9, "i", 25, -999.99)]
    at = str(tmp_path / "customer.parquet")
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double").write.parquet(at)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW customer AS SELECT * FROM '{at}/*.parquet'")
    want = sorted(duck.execute(catalog.SQL["canonical_json"]).fetchall(), key=str)
    assert sorted(map(tuple, catalog.QUERIES["canonical_json"](spark, str(tmp_path)).collect()), key=str) == want
    assert (1, '{"balance":-0.0,"c_custkey":1,"c_name":"a"}') in want


def _smallest(points, defs):
    out = {}
    for pid, doc, line in points:
        hits = [(e - s, -s, i) for d, s, e, i in defs if d == doc and s <= line <= e]
        if hits:
            out[pid] = min([*hits, *([out[pid]] if pid in out else [])])
    return {pid: k[2] for pid, k in out.items()}


def test_innermost_ranges_of_random_documents(spark):
    """Ranges across several cells, equal ones, empty ones, points that repeat an id."""
    rng = random.Random(5)
    starts = [(rng.choice("ab"), rng.randrange(-40, 300), i) for i in range(300)]
    defs = [(d, s, s + rng.choice((-1, 0, 3, 15, 16, 17, 90, 200)), i) for d, s, i in starts] + [("a", 10, 12, 900), ("a", 10, 12, 899)]
    points = [(i // 2 if i < 40 else i, rng.choice("abc"), rng.randrange(-60, 500)) for i in range(400)]
    got = intervals.innermost(spark.createDataFrame(points, "pid long, doc string, line long"), spark.createDataFrame(defs, "doc string, start long, end long, id long"), 16)
    assert dict(got.collect()) == _smallest(points, defs)


def test_very_many_ranges_over_the_same_lines(spark):
    """60,000 ranges under each of 60,000 points are not 3,600,000,000 pairs."""
    n = 60_000
    defs = spark.range(n).selectExpr("'a' as doc", "id % 3 as start", "id % 3 + 40 as end", "id")
    points = spark.range(n).selectExpr("id as pid", "'a' as doc", "5 + id % 20 as line")
    began = time.monotonic()
    assert intervals.innermost(points, defs).groupBy("id").count().collect() == [(2, n)]
    assert time.monotonic() - began < 60


def test_shuffles_follow_the_tables(spark, tmp_path, monkeypatch):
    """A task of a grouping holds no more where the tables are larger; the session's own number is not touched."""
    from loam.functions import shared

    spark.range(3_000).selectExpr("id as p_partkey", "id % 7 as p_size", "cast(id as string) as p_name", "'t' as p_type", "'b' as p_brand", "1.5 as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    own = spark.conf.get("spark.sql.shuffle.partitions")
    dealt = lambda: spark.range(9).repartition("id").rdd.getNumPartitions()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        monkeypatch.setattr(shared, "SHUFFLE_BYTES", 1 << 10)
        shared.size_shuffles(spark, str(tmp_path))
        first = spark.conf.get(shared._FIRST)
        assert int(first) > int(own) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        monkeypatch.setattr(shared, "SHUFFLE_BYTES", 1 << 40)
        catalog.QUERIES["key_concepts"](spark, str(tmp_path))
        assert spark.conf.get(shared._FIRST, None) is None and dealt() == int(own)
        monkeypatch.setattr(shared, "SHUFFLE_BYTES", 1 << 10)
        catalog.QUERIES["key_concepts"](spark, str(tmp_path))
        assert spark.conf.get(shared._FIRST) == first
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset(shared._FIRST)


def test_partners_of_consumers_of_very_many_contracts(spark):
    """Words of 64 contracts, negative ones and slices of a large consumer, against sets."""
    rng = random.Random(8)
    edges = {(rng.randrange(-300, 300), rng.randrange(12)) for _ in range(900)} | {(c, 99) for c in range(100, 180)} | {(5_000, 77)}
    sets = {}
    for c, k in edges:
        sets.setdefault(k, set()).add(c)
    want = {}
    for c, k in edges:
        want.setdefault(c, set()).update(sets[k] - {c})
    df = spark.createDataFrame(sorted(edges), "contract long, consumer long")
    for hot in (7, 512):
        plan = federation.partners(df, hot)
        assert dict(plan.collect()) == {c: len(v) for c, v in want.items() if v}
        assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_partners_shuffle_lists_and_no_pairs(spark):
    """Each consumer's contracts go out once for every block, also in several pieces and blocks; nulls are no partners."""
    rng = random.Random(9)
    edges = [(rng.choice((-1, 1)) * rng.randrange(40_000), k) for k in range(150) for _ in range(60)] + [(None, 1), (7, None), (9, None)]
    want = {}
    for k in range(150):
        mine = {c for c, m in edges if m == k and c is not None}
        for c in mine:
            want.setdefault(c, set()).update(mine - {c})
    kept = federation.PIECE, federation.PAIRS
    try:
        federation.PIECE, federation.PAIRS = 50, 100
        df = spark.createDataFrame(edges, "contract int, consumer long").repartition(3, "consumer")
        assert dict(federation.partners(df).collect()) == {c: len(v) for c, v in want.items()}
        sent = sum(p.num_rows for p in federation._counts(_batches(edges), 512))
    finally:
        federation.PIECE, federation.PAIRS = kept
    assert sent <= 2 * len(want) * len({c // federation.BLOCK for c in want})
    size = [sum(len(x) for b in federation._pieces(_lists(n)) for c in (2, 3) for x in b.column(c).to_pylist()) for n in (500, 1000)]
    assert size == [1000, 2000]  # two bytes a contract, not its pairs


def test_contract_report_shuffles_its_edges_once(spark):
    """All uses of the edges read the same lines, so that one shuffle serves them all."""
    plan = catalog.QUERIES["contract_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    read = [x for x in plan.splitlines() if "Filter" in x and "isnotnull(l_orderkey" in x]
    assert len(read) == 4 and all("isnotnull(l_suppkey" in x for x in read)


def test_grams_are_kept_as_lists_also_after_a_merge(spark, tmp_path):
    """A gram's ids share rows, with texts of more characters than one number has room for beside the row, and after rows were replaced."""
    at = search_store.create(spark, f"{tmp_path}/at", {"t": 1.0}, 2)
    for k in range(5):
        at = search_store.apply(at, spark.range(k * 50, k * 50 + 60).selectExpr("id", f"concat('ABab{k} ', id % 3) as t"))
    merged = search_store.merge(at)
    assert len(at.segments) == 5 and len(merged.segments) == 1
    pairs = {(i, t[j : j + 3]) for i in range(260) for t in [f"abab{min(i // 50, 4)} {i % 3}"] for j in range(len(t))}
    for s in (at, merged):
        lists = s.table("grams")
        found = [(r["id"], r["gram"]) for r in s.live(search_store.gram_rows(lists)).select("id", "gram").collect()]
        assert sorted(found) == sorted(pairs) and lists.count() < len(pairs) / 3
    wide = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
    rows = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([wide, *["abcd"] * 8])], names=["id", "t"])
    assert search_store._lists_of(rows) is None
    assert search_store._grams(spark.createDataFrame([(i, t) for i, t in zip(range(9), rows.column(1).to_pylist(), strict=True)], "id long, t string").coalesce(1), {"t": 1.0}).count() == len({wide[k : k + 3].lower() if k < 100 else wide[k : k + 3] for k in range(len(wide))}) + 8 * 4


def _lists(n):
    yield pa.RecordBatch.from_arrays([pa.array([list(range(n))]), pa.array([True])], names=["contracts", "known"])


def _batches(edges):
    lists = {}
    for c, k in edges:
        if c is not None:
            lists.setdefault(k, []).append(c)
    known = [(v, k is not None) for k, v in lists.items()]
    found = [r for b in federation._pieces([pa.RecordBatch.from_arrays([pa.array([v for v, _ in known], pa.list_(pa.int64())), pa.array([x for _, x in known])], names=["contracts", "known"])]) for r in b.to_pylist()]
    found.sort(key=lambda r: (r["i"], r["j"]))
    yield pa.RecordBatch.from_pylist(found, pa.schema(list(zip("ijab", federation._PIECE, strict=True))))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_and_paths_stay_where_they_are(spark):
    """Steps from few vertices and few roots do not shuffle the many rows beside them; a large front still joins."""
    edges = spark.range(400).selectExpr("id % 40 as src", "id % 40 + 1 as dst")
    seeds = spark.createDataFrame([(1,), (1,)], "id long")
    seen = []
    real, graph._cut = graph._cut, lambda df: seen.append(_plan(df)) or real(df)
    try:
        got = sorted(map(tuple, graph.reach(edges, seeds, 3).collect()))
        assert got == [(1, 0), (2, 1), (3, 2), (4, 3)]
        assert all("BroadcastHashJoin" in p for p in seen[1:]) and not any("SortMergeJoin" in p.split("BroadcastHashJoin")[-1] for p in seen[1:])
        most, graph.BROADCAST_SCORES = graph.BROADCAST_SCORES, 0
        assert sorted(map(tuple, graph.reach(edges, seeds, 3).collect())) == got
        graph.BROADCAST_SCORES = most
    finally:
        graph._cut = real
    roots = spark.createDataFrame([("src", "root"), ("src/a", "a")], "root string, module string")
    files = spark.createDataFrame([("src/a/x.go",), ("src/ab/x.go",), ("lib/x.go",), ("src/a",)], "path string")
    found = modules.longest_prefix(files, roots)
    assert dict(found.collect()) == {"src/a/x.go": "a", "src/ab/x.go": "root", "src/a": "a"} and "BroadcastHashJoin" in _plan(found)


def test_postings_and_grams_as_plain_loops_make_them(spark):
    """Missing texts, signs beyond 16 bits, letters whose lower case is longer, batches that are cut; no regular expression runs at every place."""
    texts = [(1, "The the_1 OF", None, 3), (2, None, "\U0001d518b É\nAB", 4), (3, "", "İx a a", 5), *[(i, f"w{i % 7} the", "x y " * (i % 5), 6) for i in range(4, 60)]]
    df = spark.createDataFrame(texts, "id long, name string, documentation string, length long")
    fields, small = {"name": 1.0, "documentation": 0.5}, search_store.ROWS
    lower = str.maketrans({c: c.lower() for c in string.ascii_uppercase})
    grams = {(i, t.translate(lower)[k : k + 3]) for i, *ts, _ in texts for t in ts if t for k in range(len(t))}
    want = {(w, f, i, n, [k for k, x in enumerate(ws) if x == w].__repr__()) for i, *ts, n in texts for f, t in enumerate(ts) if t for ws in [re.findall("[a-z0-9_]+", t.lower())] for w in ws}
    found = search_store._grams(df, fields)
    assert sorted(map(tuple, found.select("id", "gram").collect())) == sorted(grams)
    got = search_store._postings(df, fields).collect()
    assert {(r["term"], r["field"], r["id"], r["length"], repr(r["positions"])) for r in got} == want and len(got) == len(want)
    assert all(r["tf"] == len(r["positions"]) for r in got) and small == 100_000 and "regexp" not in _plan(found)
