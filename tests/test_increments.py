"""Closures under changes, snapshots compared by their trees, annotated files."""

import random

import pytest

from loam.operators import closure
from loam.sources import readers, snapshot_tree


def _reach(edges, seeds):
    out = set()
    for s in seeds:
        todo, seen = [s], {s}
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= {(s, x) for x in seen}
    return out


@pytest.mark.parametrize(("seed", "listed"), [(1, 500), (2, 0)])
def test_closure_under_mixed_changes_equals_one_built_anew(spark, monkeypatch, seed, listed):
    monkeypatch.setattr(closure, "LISTED", listed)
    rng = random.Random(seed)
    df = lambda e: spark.createDataFrame(sorted(e), "src long, dst long")
    edges = {(rng.randrange(25), rng.randrange(25)) for _ in range(35)} | {(1, 2), (2, 1), (2, 3), (3, 3)}
    seeds = [1, 2, 7, 90]
    s = spark.createDataFrame([(x,) for x in seeds], "id long")
    kept = closure.built(df(edges), s)
    assert {tuple(r) for r in kept.collect()} == _reach(edges, seeds)
    for _ in range(2):
        went = set(rng.sample(sorted(edges), 9)) | {(70, 71)}
        came = {(rng.randrange(28), rng.randrange(28)) for _ in range(4)} | {sorted(went)[0]}
        kept = closure.maintained(kept, df(edges).unionByName(df(edges)), df(came), df(went))
        edges = (edges - went) | came
        rows = [tuple(r) for r in kept.collect()]
        assert set(rows) == _reach(edges, seeds) and len(rows) == len(set(rows))


def test_cycle_that_loses_its_way_in(spark):
    """Pairs on a cycle do not hold each other up once the only edge into it is gone."""
    df = lambda *e: spark.createDataFrame(e, "src long, dst long")
    edges = [(1, 2), (2, 3), (3, 4), (4, 2), (4, 5)]
    kept = closure.built(df(*edges), spark.createDataFrame([(1,)], "id long"))
    got = closure.maintained(kept, df(*edges), df((9, 9)).limit(0), df((1, 2)))
    assert [tuple(r) for r in got.collect()] == [(1, 1)]


@pytest.mark.parametrize(("most", "broadcast"), [(25, 200_000), (60, 1)])
def test_closure_by_pieces_equals_pairs(spark, monkeypatch, most, broadcast):
    for name, value in (("BROADCAST", broadcast), ("MEMBERS", 2), ("SMALL", 0)):
        monkeypatch.setattr(closure, name, value)
    rng = random.Random(most)
    df = lambda e: spark.createDataFrame(sorted(e), "src long, dst long")
    edges = {(rng.randrange(most), rng.randrange(most)) for _ in range(40)} | {(1, 2), (2, 1), (2, 3), (3, 3), (-5, -6), (-6, -5)}
    seeds = [1, 2, 7, 90, -5]
    kept = closure.condensed(df(edges), spark.createDataFrame([(x,) for x in seeds], "id long"))
    assert {tuple(r) for r in closure.pairs(kept).collect()} == _reach(edges, seeds)
    went = set(rng.sample(sorted(edges), 9)) | {(70, 71)}
    came = {(rng.randrange(most + 3), rng.randrange(most + 3)) for _ in range(6)} | {sorted(went)[0]}
    kept = closure.changed(kept, df(edges).unionByName(df(edges)), df(came), df(went))
    rows = [tuple(r) for r in closure.pairs(kept).collect()]
    assert set(rows) == _reach((edges - went) | came, seeds) and len(rows) == len(set(rows))


def test_vertices_that_lead_to_each_other_are_one_piece(spark, monkeypatch):
    """All pairs of a piece are one row until they are asked for; a piece that falls apart is none any more, the other stays."""
    monkeypatch.setattr(closure, "SMALL", 0)
    all_of = lambda *ids: [(a, b) for a in ids for b in ids if a != b]
    edges = [*all_of(*range(12)), *all_of(*range(100, 109)), (5, 100)]
    df = lambda e: spark.createDataFrame(e, "src long, dst long")
    kept = closure.condensed(df(edges), spark.createDataFrame([(i,) for i in range(12)], "id long"))
    assert kept.closure.count() == 2 and kept.pieces.count() == 11 + 8
    assert closure.pairs(kept).count() == 12 * 21
    went = [e for e in edges if e[1] < 12 and e[0] < 12 and e[0] >= e[1]]
    apart = closure.changed(kept, df(edges), df(went).limit(0), df(went))
    assert apart.pieces.count() == 8
    assert {tuple(r) for r in closure.pairs(apart).collect()} == _reach(set(edges) - set(went), range(12))


def test_trees_find_what_a_full_join_finds(spark, tmp_path):
    rng = random.Random(3)
    rows = {i: (i, rng.choice("abc"), rng.random()) for i in range(4_000)}
    base = [*rows.values(), (7, "again", 0.5), (7, "again", 0.5), (None, "null key", None)]
    new = {i: r for i, r in rows.items() if i not in (11, 600)} | {5: (5, "z", 0.1), 9_001: (9_001, "new", None)}
    new = [*new.values(), (7, "again", 0.5), (None, "null key", None)]
    frame = lambda r: spark.createDataFrame(r, "k long, a string, b double")
    for name, r in (("base", base), ("new", new), ("same", list(reversed(base))), ("none", [])):
        snapshot_tree.write(frame(r), ["k"], f"{tmp_path}/{name}")
    compare = lambda x, y: {tuple(r) for r in snapshot_tree.compare(spark, f"{tmp_path}/{x}", f"{tmp_path}/{y}", ["k"]).collect()}
    assert compare("base", "new") == {(5, "modified"), (7, "modified"), (11, "deleted"), (600, "deleted"), (9_001, "added")}
    assert compare("base", "same") == set() and snapshot_tree.root(spark, f"{tmp_path}/base") == snapshot_tree.root(spark, f"{tmp_path}/same")
    assert len(compare("none", "new")) == len({r[0] for r in new}) and snapshot_tree.root(spark, f"{tmp_path}/none") == ""
    leaves = snapshot_tree.differing_leaves(spark, f"{tmp_path}/base", f"{tmp_path}/new")
    assert len(leaves) == 5
    read = snapshot_tree.rows_of(spark, f"{tmp_path}/base", leaves)
    assert 4 <= read.count() < 40  # of 4,003 rows
    assert "PartitionFilters: [top" in read._jdf.queryExecution().executedPlan().toString()


def test_annotated_files(spark):
    """Short headers of known commits, texts that look like headers, empty lines, other line ends, facts that are missing."""
    a, b, c = "a" * 40, "0123456789abcdefABCD" * 2, "c" * 40
    facts = lambda n, m, t: f"author {n}\nauthor-mail <{m}>\nauthor-time {t}\nauthor-tz +0100\ncommitter x\nsummary author of things\nfilename f.go\n"
    text = f"{a} 1 1 2\n{facts('Ann B', 'ann@x.org', 1_700_000_000)}\tpackage x\n{a} 2 2\n\t\n{b} 9 3 1\n{facts('Bo', '', 1_600_000_000)}boundary\n\t{a} 1 1 2\n{a} 4 4 1\n\t\tauthor Eve\n{c} 5 5\n\tend"
    rows = [(1, text), (2, text.replace("\n", "\r\n")), (3, ""), (4, None), (5, f"fatal: no such path\n{c} 1 1 1\n{facts('Cy', 'c@x.org', 0)}\tlast\n")]
    got = {}
    for r in readers.blame(spark.createDataFrame(rows, "path int, text string")).collect():
        got.setdefault(r["path"], {})[r["line"]] = (r["commit"], r["author"], r["email"], r["ts"] and int(r["ts"].timestamp()), r["text"])
    one = {1: (a, "Ann B", "ann@x.org", 1_700_000_000, "package x"), 2: (a, "Ann B", "ann@x.org", 1_700_000_000, ""), 3: (b, "Bo", "", 1_600_000_000, f"{a} 1 1 2"), 4: (a, "Ann B", "ann@x.org", 1_700_000_000, "\tauthor Eve"), 5: (c, None, None, None, "end")}
    assert got == {1: one, 2: one, 5: {1: (c, "Cy", "c@x.org", 0, "last")}}
