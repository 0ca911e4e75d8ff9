"""The search index: phrases, prefixes, substrings and tiers against plain searching, and an index kept current against one built anew."""

import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from loam.functions import files
from loam.operators import graph, retrieval, search
from loam.sources import search_store as store
from loam.sources import writers

FIELDS = {"name": 1.0, "documentation": 0.5, "signature": 0.3}
WORDS = ["parse", "parser", "Index", "file", "files", "the", "a", "read_all", "x1", "Über", "naïve"]
SCHEMA = "id long, name string, documentation string, signature string, tf int, term string"


def _rows(seed, ids):
    rng = random.Random(seed)
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(WORDS) for _ in range(rng.randint(0, n)))
    return [(i, rng.choice([None, text(3)]), text(30), rng.choice([None, "", text(5)])) for i in ids]


def _df(spark, rows):
    """With columns whose names clash with those of the index."""
    return spark.createDataFrame([(*r, 1, "t") for r in rows], SCHEMA)


def _tok(text):
    return re.findall("[a-z0-9_]+", (text or "").lower())


def _plain(rows, query):
    """What the three tiers must find: ids by phrase, prefix and substring, and each phrase's and prefix's score to 9 places."""
    import math

    terms = _tok(query)
    n, mean = len(rows), sum(len(_tok(f)) for r in rows for f in r[1:]) / max(1, len(rows))

    def bm25(units):
        found = {}
        for hits in units:
            for i, (f, length) in hits.items():
                idf = math.log(1 + (n - len(hits) + 0.5) / (len(hits) + 0.5))
                found.setdefault(i, []).append(idf * f * (search.K1 + 1) / (f + search.K1 * (1 - search.B + search.B * length / mean)))
        return {i: round(sum(s), 9) for i, s in found.items() if len(s) == len(units)}

    def hits(count):
        out = {}
        for r in rows:
            f = sum(w * count(_tok(t)) for w, t in zip(FIELDS.values(), r[1:], strict=True))
            if f > 0:
                out[r[0]] = (f, sum(len(_tok(t)) for t in r[1:]))
        return out

    k = len(terms)
    phrase = bm25([hits(lambda t: sum(t[i : i + k] == terms for i in range(len(t) - k + 1)))]) if terms else {}
    prefix = bm25([*[hits(lambda t, x=x: t.count(x)) for x in sorted(set(terms[:-1]))], hits(lambda t: sum(x.startswith(terms[-1]) for x in t))]) if terms else {}
    like = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in query.lower().replace("Ü", "Ü")), re.S)
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    return phrase, prefix, {r[0] for r in rows if any(t is not None and like.search(low(t)) for t in r[1:])}


def _found(at, query):
    score = lambda df: {r["id"]: round(r["score"], 9) for r in df.collect()}
    return score(retrieval.phrase(at, query)), score(retrieval.prefix(at, query)), {r["id"] for r in retrieval.substring(at, query).collect()}


QUERIES = ["the the", "file pars", "e, p", "ndex%ile", "ïve", "%", "read_al", "...", "x"]


@pytest.mark.parametrize("few", [True, False])
def test_tiers_equal_plain_searching(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(retrieval, "FEW_IDS", 10_000 if few else 0)
    rows = _rows(1, range(200)) + [(900, "", "", ""), (901, None, None, None), (902, "ab", "", None)]
    at = store.apply(store.create(spark, str(tmp_path), FIELDS, 8), _df(spark, rows))
    assert at.docs == len(rows)
    for q in QUERIES if few else QUERIES[1:4]:
        assert _found(at, q) == _plain(rows, q), q


def test_search_takes_each_row_once_in_its_best_tier(spark, tmp_path):
    rows = [(1, "open file", "", ""), (2, "file openers", "x", ""), (3, "reopen filer", "", ""), (4, "open_file", "", ""), (5, "", "Open File open file", None), (6, "shut", "", "")]
    at = store.apply(store.create(spark, str(tmp_path), FIELDS, 4), _df(spark, rows))
    got = [(r["id"], r["tier"], r["rank"]) for r in retrieval.search(at, " open file ", 10).collect()]
    assert got == [(5, 1, 1.0), (1, 1, 1.0), (3, 3, 0.5)] or got == [(1, 1, 1.0), (5, 1, 1.0), (3, 3, 0.5)]
    assert [r["id"] for r in retrieval.search(at, "open", 10, spark.createDataFrame([(2,), (3,), (4,)], "id long")).collect()] == [4, 2, 3]
    assert retrieval.search(at, "open file", 2).count() == 2 and retrieval.search(at, "  ", 5).count() == 0


def test_no_text_is_scanned(spark, tmp_path):
    rows = _rows(2, range(400))
    rows[7] = (7, "needle in hay", "zq9", None)
    at = store.apply(store.create(spark, str(tmp_path), FIELDS, 16), _df(spark, rows))
    kinds = lambda df: {f.split("/segments/")[1].split("/")[1] for f in df.inputFiles()}
    assert kinds(retrieval.phrase(at, "needle in")) == {"postings"}
    assert kinds(retrieval.prefix(at, "need")) == {"postings"}
    plan = retrieval.substring(at, "EEDLE I")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ = \d+\)\]", plan)  # one of sixteen parts is read


def test_index_kept_current_equals_one_built_anew(spark, tmp_path):
    """Inserts, updates, deletes, ids that come back, and merges: after every batch as a fresh index of the same rows; old versions stay readable."""
    rng, at, live = random.Random(5), store.create(spark, f"{tmp_path}/kept", FIELDS, 8), {}
    states = [({}, at.version)]
    for step in range(5):
        ids = rng.sample(range(60), 25)
        rows = _rows(100 + step, ids)
        gone = rng.sample(range(80), 12)
        at = store.apply(at, _df(spark, rows) if step != 3 else None, spark.createDataFrame([(i,) for i in gone] + [(None,)], "id long"))
        live = {i: r for i, r in live.items() if i not in gone} | ({r[0]: r for r in rows} if step != 3 else {})
        if step in (3, 4):
            before = len(at.segments)
            at = store.merge(at, 3)
            assert len(at.segments) == (1 if step == 3 else before)
        states.append((dict(live), at.version))
        assert at.docs == len(live) and at.tokens == sum(len(_tok(f)) for r in live.values() for f in r[1:])
    fresh = store.apply(store.create(spark, f"{tmp_path}/fresh", FIELDS, 8), _df(spark, list(live.values())))
    for q in ("index file", "ndex f"):
        assert _found(at, q) == _found(fresh, q) == _plain(list(live.values()), q)
    held, version = states[2]
    assert _found(store.open_index(spark, f"{tmp_path}/kept", version), "the") == _plain(list(held.values()), "the")
    assert store.vacuum(spark, f"{tmp_path}/kept") > 0 and _found(store.open_index(spark, f"{tmp_path}/kept"), "parse") == _found(fresh, "parse")


def test_a_batch_reads_its_parts_only_and_versions_are_taken_once(spark, tmp_path):
    at = store.apply(store.create(spark, str(tmp_path), FIELDS, 8), _df(spark, _rows(3, range(50))))
    again = store.apply(at, _df(spark, [(7, "twice", "", ""), (7, "once", "", "")]))
    assert again.docs == 50 and {r["id"] for r in retrieval.phrase(again, "twice").collect()} == {7}
    with pytest.raises(FileExistsError):  # another writer has taken the version
        store.apply(at, _df(spark, [(8, "late", "", "")]))
    assert {s["rows"] for s in again.segments} == {50, 1}
    empty = store.apply(store.create(spark, f"{tmp_path}/e", FIELDS), _df(spark, []))
    assert empty.docs == 0 and _found(empty, "x") == ({}, {}, set())


def test_due_runs_keep_their_order():
    seg = lambda *n: tuple({"name": str(i), "rows": r, "gone": 0} for i, r in enumerate(n))
    assert store.due(seg(1000, 5, 5, 5, 5), 4) == (1, 5)
    assert store.due(seg(5, 5, 1000, 5, 5), 4) is None
    assert store.due(seg(70, 70, 5, 5, 70, 70), 4) == (0, 6)
    assert store.due((), 4) is None


def test_a_rewritten_table_is_indexed_anew(spark, tmp_path):
    path = f"{tmp_path}/docs.parquet"
    put = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/new")
    ids = []
    for texts in (("alpha", "beta", "beta"), ("beta", "beta", "alpha")):
        put(*texts)
        shutil.rmtree(path, ignore_errors=True)
        part = next(n for n in files.names(spark, f"{tmp_path}/new") if n.startswith("part"))
        shutil.copytree(f"{tmp_path}/new", path)
        shutil.move(f"{path}/{part}", f"{path}/part-0.parquet")  # under the same name as before
        spark.catalog.refreshByPath(path)
        df = spark.read.parquet(path)
        at, _ = writers.search_index(df, "doc_id", "text")
        assert writers.search_index(df, "doc_id", "text")[0] == at
        kept = store.index_of(df, df.select(F.col("doc_id").alias("id"), F.col("text").alias("name")), "t", {"name": 1.0}, 2)
        ids.append([r["doc_id"] for r in writers.lookup_postings(spark, at, ["alpha"]).collect()] + [r["id"] for r in retrieval.phrase(kept, "alpha").collect()])
        assert [r["doc_id"] for r in writers.clustered(df, df, "c", "text", "doc_id").where("text = 'alpha'").collect()] == ids[-1][:1]
    assert ids == [[0, 0], [2, 2]]


def test_push_equals_full_steps_for_many_seed_sets(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30), float(rng.randint(1, 5))) for _ in range(90)] + [(40, 41, 1.0), (3, 3, 2.0)]
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    seeds = {"a": [1, 2, 99], "b": [40], "c": [77]}
    s = spark.createDataFrame([(q, i) for q, ids in seeds.items() for i in ids], "query string, id long")
    g = graph.transitions(e).cache()
    want = {(q, r["id"]): round(r["score"], 9) for q, ids in seeds.items() for r in graph.pagerank(e, spark.createDataFrame([(i,) for i in ids], "id long"), tolerance=0.0).collect() if r["score"] > 0}
    for most in (graph.BROADCAST_SCORES, 0):
        monkeypatch.setattr(graph, "BROADCAST_SCORES", most)
        got = {(r["query"], r["id"]): round(r["score"], 9) for r in graph.push(g, s, least=0.0, steps=20 if most else 3).collect()}
        if most:
            assert got == want and {q for q, _ in got} == {"a", "b"}
    monkeypatch.setattr(graph, "BROADCAST_SCORES", 500_000)
    near = {(r["query"], r["id"]): r["score"] for r in graph.push(g, s, least=0.01).collect()}
    assert len(near) < len(want) and all(want[k] - (1 - sum(v for x, v in near.items() if x[0] == k[0])) - 1e-9 <= v <= want[k] + 1e-9 for k, v in near.items())


def test_push_of_many_scores_along_dealt_edges(spark, monkeypatch):
    """Edges dealt by either end give the same scores, each is dealt once, and nothing stays behind."""
    rng = random.Random(5)
    e = spark.createDataFrame([(rng.randrange(30), rng.randrange(30), 1.0) for _ in range(90)], "src long, dst long, weight double")
    g, s = graph.transitions(e).cache(), spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "query string, id long")
    scores = lambda: {(r["query"], r["id"]): round(r["score"], 9) for r in graph.push(g, s, least=0.0, steps=4).collect()}
    want, held = scores(), spark.sparkContext._jsc.getPersistentRDDs().size()
    for name, value in (("LISTED_SOURCES", 2), ("DEALT_FROM", 3), ("BROADCAST_SCORES", 20)):
        monkeypatch.setattr(graph, name, value)
    assert scores() == want and spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_fusion_by_hand(spark):
    found = spark.createDataFrame([("q", 1, 1, 1.0, 0.5), ("q", 2, 2, 0.8, 0.0), ("q", 3, 3, 0.5, 0.1), ("r", 1, 3, 0.5, 0.2)], "query string, id long, tier int, rank double, ppr double")
    features = spark.createDataFrame([(1, 10, 5), (2, 20, 9)], "id long, hotspot int, recency int")
    got = {(r["query"], r["id"]): round(r["fused"], 6) for r in retrieval.fused(found, features).collect()}
    assert got[("q", 1)] == round(0.4 + 0.3 + 0.15 * 0.5 + 0.1 * 5 / 9 + 0.05, 6)
    assert got[("q", 2)] == round(0.4 * 0.6 + 0.15 + 0.1, 6) and got[("q", 3)] == round(0.3 * 0.2, 6)
    assert got[("r", 1)] == round(0.5 * (0.4 + 0.3 + 0.15 + 0.1), 6)
