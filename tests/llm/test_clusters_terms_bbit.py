"""Ball k-means, source divergence and b-bit MinHash against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import awkward, near_corpus, odd_rows, prose, table

from loam.llm import ball_kmeans, bbit_minhash, ngram_join, source_terms

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, v int, distance double"


def vectors(spark, rows):
    """Vectors with columns whose names clash with those of the operator."""
    return spark.createDataFrame([(i, x, 0, "c", 1, 2.0) for i, x in rows], VECTORS)


def plain_kmeans(rows, k=16, rounds=3):
    """Lloyd's rounds as the contract words them, all centroids compared."""
    kept = [(i, tuple(floor(64 * float(np.float32(y))) for y in x)) for i, x in rows if x is not None and len(x) == 64 and all(y is not None and np.isfinite(np.float32(y)) for y in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for t in range(rounds + 1):
        at = [min((far(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
        if t < rounds:
            for j in range(len(cents)):
                own = [v for (_, v), (_, a) in zip(kept, at, strict=True) if a == j]
                if own:
                    cents[j] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    total = sum(d for d, _ in at)
    per = Counter()
    for d, j in at:
        per[j] += d
    return Counter((i, j, d, per[j], total, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at, strict=True))


def blobs(seed, n, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (9, 64))
    return [(i, [float(y) for y in (centres[i % 9] + rng.normal(0, spread, 64)).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_ball_kmeans_equals_plain_rounds(spark, spread):
    rows = blobs(3, 300, spread)
    got = Counter(tuple(r) for r in ball_kmeans.clusters(vectors(spark, rows)).collect())
    assert got == plain_kmeans(rows)


def test_ball_kmeans_of_odd_vectors(spark):
    """Ties, repeated and null ids, equal vectors, wrong lengths, null and non-finite components, few vectors, none."""
    same = [0.5] * 64
    lattice = [(100 + i, [float((i >> k) & 1) for k in range(4)] + [0.0] * 60) for i in range(16)]
    middle = [(200 + i, [0.5] * (i % 4 + 1) + [0.0] * (63 - i % 4)) for i in range(12)]
    odd = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 63 + [None]), (5, [float("nan")] * 64), (6, [float("inf")] + same[1:]), (7, same), (7, same), (8, same), (None, same), (None, [-1.0] * 64), (9, [-0.001] * 64)]
    for rows in (odd, lattice + middle + odd, odd[:6]):
        got = Counter(tuple(r) for r in ball_kmeans.clusters(vectors(spark, rows)).collect())
        assert got == plain_kmeans(rows)
    with pytest.raises(Exception, match="beyond"):
        ball_kmeans.clusters(vectors(spark, [(1, [1e9] * 64)])).collect()


def test_balls_prune_but_lose_nothing():
    rng = np.random.default_rng(7)
    cents = rng.integers(-40, 40, (12, 8))
    v = cents[rng.integers(0, 12, 2000)] + rng.integers(-9, 10, (2000, 8))
    at, best = ball_kmeans.nearest(v, cents)
    moved = cents + rng.integers(-2, 3, cents.shape)
    radii = [int(np.sqrt(ball_kmeans.squared(v[at == j], moved[j : j + 1]).max())) + 1 if (at == j).any() else -1 for j in range(12)]
    new, d, compared = ball_kmeans.reassign(v, at, moved, ball_kmeans.neighbours(moved, radii))
    want, far = ball_kmeans.nearest(v, moved)
    assert (new == want).all() and (d == far).all()
    assert compared < 2000 * 11 / 3


def plain_audit(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", Counter(term.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in d[2])
        kept = [t for t, n in held.items() if n >= least]
        counts = defaultdict(Counter)
        for _, s, c in mine:
            counts[s].update({t: n for t, n in c.items() if t in set(kept)})
        def scaled(c):
            size = sum(c.values())
            return {t: 1 + floor(Fraction(1_000_000_000 * (c[t] + 5), size + 5 * len(kept))) for t in kept}
        p = {s: scaled(c) for s, c in counts.items()}
        q = scaled(sum(counts.values(), Counter()))
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            terms = sorted((-(p[s][t] - q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -f, r) for part, found in (("pair", pairs), ("term", terms)) for r, (f, i) in enumerate(found, 1)]
    return Counter(out)


@pytest.mark.parametrize("short", [True, False])
def test_source_audit_equals_plain_counting(spark, monkeypatch, short):
    monkeypatch.setattr(source_terms, "BROADCAST_GROUPS", 1000 if short else 0)
    rng = random.Random(2)
    rows = [(prose(rng.randint(0, 60), rng) + rng.choice(["", " É🙂x A1b_C", " ", "\x00"]), rng.choice(["en", "de", None]), rng.choice(["s", "t", "ü", None, "z"])) for _ in range(150)]
    rows += [(None, "en", "empty"), ("", "fr", "a"), ("1 2 3", "fr", "b"), ("one", "it", None), ("x " * 40_000, "en", "s"), *[("hot words", "en", "hot")] * 200]
    df = spark.createDataFrame([(i, *r, "p", 1, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int, value string")
    got = Counter(tuple(r) for r in source_terms.audit(df, least=4, top=7).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(rows, 4, 7)
    assert any(r[2] == "term" for r in got) and any(r[0] == "fr" and r[4] == 0 for r in got)
    assert source_terms.audit(df.limit(0)).count() == 0


def brute_two_words(ids, texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(w, w[1:], strict=False)) if len(w) >= 2 else frozenset(w))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 5 >= max(len(sets[i]), len(sets[j])) * 4:
            shared = len(sets[i] & sets[j])
            if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                parent[a] = b
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return Counter((x, len(sets[i]), low[find(i)], x == low[find(i)]) for i, x in enumerate(ids))


@pytest.mark.parametrize(("seed", "tight"), [(3, False), (4, True)])
def test_bbit_finds_every_link(spark, monkeypatch, seed, tight):
    if tight:
        monkeypatch.setattr(bbit_minhash, "BLOCK", 2)
        monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    texts = near_corpus(seed) + ["a b", "b a", "A b", "a", "A", "a b c d e", "x a b c d e", "a b c d e f"]
    ids = [i * 3 + 1 for i in range(len(texts))]
    got = Counter(tuple(r) for r in bbit_minhash.near_duplicates(table(spark, texts, ids)).collect())
    assert got == brute_two_words(ids, texts)


def test_mixed_buckets_are_searched(spark):
    """Links that no star finds come from the blocks of mixed buckets."""
    rng = random.Random(9)
    base = prose(300, rng).split()
    texts = []
    for _ in range(60):  # two variants at a time share edits that keep them apart from the others
        own = list(base)
        for k in rng.sample(range(len(base)), 45):
            own[k] = rng.choice("abcdefgh") * 7
        for _ in range(2):
            w = list(own)
            w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    ids = list(range(len(texts)))
    want = brute_two_words(ids, texts)
    assert len({r[2] for r in want}) > 20
    got = Counter(tuple(r) for r in bbit_minhash.near_duplicates(table(spark, texts, ids)).collect())
    assert got == want


def test_low_bits_estimate_similarity():
    rng = np.random.default_rng(5)
    for share in (0.0, 0.5, 0.8, 0.95):
        both = rng.integers(0, 1 << 63, int(600 * share), dtype=np.uint64)
        own = [rng.integers(0, 1 << 63, (600 - len(both)) // 2, dtype=np.uint64) for _ in range(2)]
        x, y = (np.unique(np.concatenate([both, o])) for o in own)
        j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        a, b = (bbit_minhash.planes(bbit_minhash.minima(s)).view(np.uint64) for s in (x, y))
        n = bbit_minhash.PLANE
        agree = bbit_minhash.BANDS * bbit_minhash.ROWS - int(np.bitwise_count((a[:n] ^ b[:n]) | (a[n:] ^ b[n:])).sum())
        assert abs(bbit_minhash.estimated(agree) - j) < 0.12


def test_agreement_in_the_jvm(spark):
    rng = np.random.default_rng(6)
    bits = rng.integers(-(1 << 62), 1 << 62, (4, bbit_minhash.PLANE * bbit_minhash.BITS))
    bits[3] = bits[0]
    df = spark.createDataFrame([(bits[0].tolist(), bits[k].tolist(), k) for k in range(4)], "a array<long>, b array<long>, k int")
    got = {r["k"]: r["n"] for r in df.select("k", bbit_minhash.agreeing("a", "b").alias("n")).collect()}
    u, n = bits.view(np.uint64), bbit_minhash.PLANE
    assert got == {k: bbit_minhash.BANDS * bbit_minhash.ROWS - int(np.bitwise_count((u[0, :n] ^ u[k, :n]) | (u[0, n:] ^ u[k, n:])).sum()) for k in range(4)}
    assert got[0] == got[3] == bbit_minhash.BANDS * bbit_minhash.ROWS


def test_bbit_of_awkward_rows(spark):
    texts = awkward()
    got = Counter(tuple(r) for r in bbit_minhash.near_duplicates(table(spark, texts)).collect())
    assert got == brute_two_words(range(len(texts)), texts)
    df = odd_rows(spark)
    rows = bbit_minhash.near_duplicates(df).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in df.select(F.col("doc_id")).collect())
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    again = bbit_minhash.near_duplicates(table(spark, ["a b c d e f g"] * 40 + ["a b c d e f g h"] * 40, [5] * 40 + [6] * 40)).collect()
    assert Counter(tuple(r) for r in again) == {(5, 6, 5, True): 40, (6, 7, 5, False): 40}
    assert bbit_minhash.near_duplicates(df.limit(0)).count() == 0
