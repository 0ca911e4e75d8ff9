"""Training-data operators: brute-force twins on small tables, awkward rows, formats and round trips."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import bpe, common, exact_dedup, langid, licenses, mixing, ngram_join, queries, secrets, tiff, toxicity, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, salt int, kept boolean, n string, keep_id string"


def table(spark, texts, ids=None):
    """Documents with columns whose names clash with those that the operators use."""
    rows = [(i, t, "en", None if k % 5 == 4 else f"s{k % 3}", 0, 7, None, "x", None) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward():
    long = prose(30_000)
    return [None, "", "   \n\t", "...", "a", "A b", "a B", prose(60), prose(60), long, long.upper(), "日本語 テキスト", "x" * 5000, "é" * 900 + " ok", "<|endoftext|> a<|ENDOFTEXT|>", "\x1c\x85 z"]


def brute_components(ids, texts):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_corpus(seed=3):
    """Groups of copies, near copies at every similarity, and passages that many texts share."""
    rng = random.Random(seed)
    shared = [prose(40, rng) for _ in range(3)]
    texts = [prose(rng.randint(1, 80), rng) for _ in range(40)]
    for _ in range(12):
        base = prose(rng.randint(20, 120), rng).split()
        for _ in range(rng.randint(2, 30)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    texts += [f"{rng.choice(shared)} {prose(rng.randint(0, 60), rng)}" for _ in range(60)]
    texts += [texts[0].upper(), None, "", " \n "]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "tight"), [(3, False), (4, True)])
def test_join_finds_every_link(spark, monkeypatch, seed, tight):
    if tight:  # few keys are listed or none, runs are short, blocks are small: every path is taken
        monkeypatch.setattr(ngram_join, "LISTED_LEAST", 4)
        monkeypatch.setattr(ngram_join, "BLOCK", 2)
        monkeypatch.setattr(ngram_join, "RUN_MOST", 3)
        monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    texts = near_corpus(seed)
    ids = [i * 3 + 1 for i in range(len(texts))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(table(spark, texts, ids)).collect()}
    assert got == brute_components(ids, texts)


def test_tree_prunes_but_loses_nothing():
    rng = random.Random(1)
    sets = []
    for _ in range(40):
        base = {rng.getrandbits(64) for _ in range(rng.randint(5, 300))}
        for _ in range(3):
            sets.append(np.array(sorted({x for x in base if rng.random() > 0.06} | {rng.getrandbits(64) for _ in range(3)}), np.uint64))
    size = np.array([len(s) for s in sets])
    comp = np.arange(len(sets)) // 2
    found = {tuple(sorted(p)) for p in ngram_join.tree_join(size, [ngram_join.bitmap(s) for s in sets], comp)}
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if comp[i] != comp[j] and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert linked <= found and len(found) < 800


def test_join_of_awkward_and_empty_tables(spark):
    texts = awkward()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(table(spark, texts)).collect()}
    assert got == brute_components(range(len(texts)), texts)
    assert ngram_join.link_components(table(spark, [])).count() == 0
    assert ngram_join.keep_one(table(spark, ["a b c d e f", "A b c d e f", "z"])).count() == 2


def test_exact_dedup(spark):
    texts = [*awkward(), *["Same Text"] * 50, "same text", "SAME TÉXT", "same tÉxt", None]
    df = table(spark, texts)
    df = df.unionByName(df.limit(1))  # a repeated row
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == len(texts) + 1
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for i, t in [*enumerate(texts), (0, texts[0])]:
        groups[low(t)].append(i)
    for r in got:
        g = groups[low(texts[r["doc_id"]])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(g), len(g), r["doc_id"] == max(g))
        assert r["text_sha256"] == hashlib.sha256(low(texts[r["doc_id"]]).encode()).hexdigest()
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    ids = [5, 5, 5, 6, 6, None, None, 8]
    twice = table(spark, ["a", "b", "A", "c", "c", None, "", "b"], ids).withColumn("n_chars", F.monotonically_increasing_id())
    left = exact_dedup.drop_copies(twice)
    assert sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in left.collect()) == [("5", "a"), ("6", "c"), ("8", "b"), ("None", "")]
    assert left.columns == twice.columns and exact_dedup.drop_copies(table(spark, [])).count() == 0
    kept = exact_dedup.drop_copies(table(spark, texts))
    assert kept.columns == table(spark, []).columns and {r["doc_id"] for r in kept.collect()} == {max(g) for g in groups.values()}


def test_mix_reaches_targets(spark):
    texts = [None, "", *[prose(RNG.randint(1, 200)) for _ in range(300)], prose(4000)]
    df = table(spark, texts)
    rows = mixing.mix(df).collect()
    again = mixing.mix(df).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(texts)
    source = {i: None if i % 5 == 4 else f"s{i % 3}" for i in range(len(texts))}
    size, want = Counter(), {}
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        size[source[r["doc_id"]]] += r["size"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    left, free = float(sum(size.values())), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 3 * size[s] < level * weight[s]}
        if not full:
            want |= {s: level * weight[s] for s in free}
            break
        want |= {s: 3.0 * size[s] for s in full}
        left -= sum(3 * size[s] for s in full)
        free -= full
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)
    assert mixing.mix(table(spark, [])).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(table(spark, [None, "", " "])).collect())
    out = mixing.repeat_to_mix(df)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})
    assert out.columns == df.columns and 0.5 * sum(size.values()) < sum(len(r["text"].split()) for r in out.collect()) < 1.5 * sum(size.values())


def brute_mix(rows, targets, schedule):
    """Every word of every source's line, laid into the blocks of the slots one by one."""
    line = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        line[r["rank"]] += [(r["uid"], r["copy"], k) for k in range(r["size"])]
    goal = {t["rank"]: int(math.floor(t["target"] + 0.5)) for t in targets}
    found = defaultdict(lambda: [0, 0, set()])
    for s in schedule:
        rank, n, nth = s["source_rank"], s["slots"], s["nth"]
        for w in range(nth * goal[rank] // n, (nth + 1) * goal[rank] // n):
            uid, copy, k = line[rank][w % len(line[rank])]
            one = found[uid, copy]
            one[0] += 1
            one[1] += k == next(r["size"] for r in rows if (r["uid"], r["copy"]) == (uid, copy)) // 2
            one[2].add(s["slot"])
    return {k: (t, c, min(s), max(s)) for k, (t, c, s) in found.items()}


def test_mix_follows_its_schedule(spark, monkeypatch):
    """Slots, words and copies against a mix made word by word; another order of the slots gives another mix."""
    texts = [prose(RNG.randint(0, 12)) for _ in range(60)]
    df = table(spark, texts)
    df = df.unionByName(df.where("doc_id in (3, 4)")).unionByName(df.where("doc_id = 3"))
    keep = {}
    placed = mixing._placed

    def spy(*args):
        keep["rows"], pieces = placed(*args)
        return keep["rows"], pieces

    monkeypatch.setattr(mixing, "_placed", spy)
    first = sorted(map(tuple, mixing.mix(df, bits=6).collect()), key=str)
    rows = [r.asDict() for r in keep["rows"].collect()]
    targets = mixing.source_targets(spark.createDataFrame([(r["source"], r["size"]) for r in rows], "source string, size long"))
    want = brute_mix(rows, targets.collect(), mixing.schedule(targets, 6).collect())
    per = sorted(((r["doc_id"], r["size"], *want.get((r["uid"], r["copy"]), (0, 0, None, None))) for r in rows), key=str)
    assert per == sorted(((d, n, taken, copies, a, b) for d, n, _, _, taken, copies, a, b, _ in first), key=str)
    plain = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda t, bits: plain(t, bits).withColumn("slot", F.lit(200) - F.col("slot")))
    assert sorted(map(tuple, mixing.mix(df, bits=6).collect()), key=str) != first


def test_mix_of_awkward_tables(spark):
    df = table(spark, [*awkward(), "same words here"] ).unionByName(table(spark, ["same words here"] * 3, [7, 7, 7])).unionByName(table(spark, ["no id at all", None]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count() and all(0 <= r["taken"] <= 3 * r["size"] and (r["taken"] > 0) == (r["first_slot"] is not None) for r in rows)
    assert mixing.repeat_to_mix(df).columns == df.columns and mixing.repeat_to_mix(table(spark, [])).count() == 0


def test_mix_cap_and_slots(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got == {"a": 30.0, "b": 980.0, None: 0.0}
    s = mixing.schedule(mixing.source_targets(sizes), 8).collect()
    assert len({r["slot"] for r in s}) == len(s)
    per = defaultdict(list)
    for r in s:
        per[r["source_rank"]].append((r["slot"], r["nth"], r["slots"]))
    for v in per.values():
        assert [n for _, n, _ in sorted(v)] == list(range(len(v))) and {m for *_, m in v} == {len(v)}


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    lib = Tokenizer.from_file(path)
    rng = random.Random(9)
    texts = [*awkward(), *["".join(rng.choice("abce '́\n<|>endoftext1AB日ÉÇ.,!") for _ in range(rng.randint(0, 300))) for _ in range(150)], "".join(rng.choice("abcdefghijklm") for _ in range(6000)), "!?" * 3000, "it's we're don't'll"]
    got = {r["doc_id"]: r for r in bpe.digest_documents(table(spark, texts), path).collect()}
    raw = bpe.encode_documents(table(spark, texts), path)
    ids = {r["doc_id"]: list(r["ids"]) for r in raw.collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(raw, path).collect()}
    for i, t in enumerate(texts):
        want = lib.encode(t or "", add_special_tokens=False).ids
        plain = lib.decode(want, skip_special_tokens=False)
        assert ids[i] == want and back[i] == plain
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
    assert bpe.digest_documents(table(spark, []), path).count() == 0


def test_bpe_small_leaves(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_CHARS", 40)
    monkeypatch.setattr(bpe, "LEAF_RUN", 8)
    e = bpe.TreeEncoder(queries.tokenizer_path())
    rng = random.Random(2)
    for _ in range(60):
        t = "".join(rng.choice("abcdeabcde  .'stlé") for _ in range(400)) + "".join(rng.choice("thein") for _ in range(200))
        assert e.encode(t) == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_bpe_of_split_texts(spark, monkeypatch):
    """Texts cut into parts for several tasks, with cuts inside words, special tokens and texts without white space."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "SPLIT_CHARS", 16)
    path = queries.tokenizer_path()
    lib = Tokenizer.from_file(path)
    texts = [*awkward(), prose(3000), "abcdefghij" * 300, ("word<|endoftext|>word " * 20).strip(), "é" * 100, " " * 200, "a" * 16, "b" * 17, "同じ テキスト " * 30, "x " * 3000]
    df = table(spark, texts)
    df = df.unionByName(df.where("doc_id = 16")).unionByName(table(spark, ["no id " * 20]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = bpe.digest_documents(df, path).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([*range(len(texts)), 16, None])
    raw = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_documents(df, path).collect()}
    for r in rows:
        t = texts[r["doc_id"]] if r["doc_id"] is not None else "no id " * 20
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert raw[r["doc_id"]] == want and r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_wavelet_files(spark):
    path = queries.tokenizer_path()
    texts = awkward()
    ids = [5, 3, 9, 1, 0, 2, 11, 30, 22, 7, 8, 40, 41, 42, 43, 44]
    rows = table(spark, texts, ids).unionByName(table(spark, ["no id", None]).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(table(spark, ["minus one"], [-1]))
    files = wavelet.write_shards(rows, path, shard_tokens=2000, range_bytes=100_000)
    assert files.count() > 2 and all(r["file"].endswith(".lwm") for r in files.collect())
    back = wavelet.read_documents(files).collect()
    assert sorted((r["start"], r["doc_id"]) for r in back)[:3] == [(0, None), (1, None), (4, -1)]
    got = {r["doc_id"]: r for r in back}
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    at = got[-1]["start"] + got[-1]["n_tokens"]
    for i, t in sorted(zip(ids, texts, strict=True)):
        want = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    assert wavelet.read_documents(wavelet.write_shards(table(spark, []), path)).count() == 0


def test_wavelet_access_rank_select():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 49408, 140_000)
    ids[::7] = 320
    f = wavelet.WaveletFile(wavelet.pack(np.array([4, 9]), np.array([0, 1000, 140_000]), ids))
    assert (f.ids() == ids).all() and (f.document(0)[:50] == ids[:50]).all() and len(f.kept) <= wavelet.KEPT_BLOCKS
    some = [0, 7, 511, 512, 513, 2999, 65_535, 65_536, 131_072, 139_999]
    assert [f.access(i) for i in some] == ids[some].tolist()
    assert f.rank(320, 70_001) == (ids[:70_001] == 320).sum() and f.rank(320, 140_000) == (ids == 320).sum()
    where = np.flatnonzero(ids == 320)
    assert f.count(320) == len(where) and f.rank(320, 100) == (ids[:100] == 320).sum() and f.count(70000) == 0
    assert [f.select(320, k) for k in (0, 5, len(where) - 1, len(where))] == [where[0], where[5], where[-1], -1]
    empty = wavelet.WaveletFile(wavelet.pack(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)))
    assert empty.count(3) == 0 and len(empty.ids()) == 0


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [0, 16])
def test_tiff_round_trip(compression, order, tile):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 4, (70, 50)).astype(np.uint8), rng.integers(0, 60000, (33, 20, 3)).astype(np.uint16), np.zeros((1, 1), np.uint8), np.tile(np.arange(256, dtype=np.uint8), (90, 2))]
    for predictor in (1, 2):
        got = list(tiff.read(tiff.write(pages, [(compression, predictor, tile)] * 4, order, 8)))
        assert [g.data for g in got] == [p.tobytes() for p in pages] and [g.number for g in got] == [0, 1, 2, 3]


def test_lzw_of_long_and_random_data():
    for data in (b"", b"a", b"ab" * 9000, np.random.default_rng(2).integers(0, 256, 40_000).astype(np.uint8).tobytes()):
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data and tiff.packbits_decode(tiff.packbits_encode(data)) == data


def test_broken_and_swollen_parts():
    """Codes without an entry are errors; no more is unpacked of a part than its page holds, give or take one entry."""
    bits = lambda *codes: (lambda b: bytes(int(b[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(b), 8)))("".join(f"{c:09b}" for c in codes))
    assert tiff.lzw_decode(bits(256, 65, 258, 257)) == b"AAA"  # the entry that is just being made
    for codes in ((256, 65, 500, 257), (256, 65, 259, 257), (256, 258, 257), (300,)):
        with pytest.raises(ValueError, match="code"):
            tiff.lzw_decode(bits(*codes))
    zeros = bytes(20_000_000)
    for kind, packed in ((tiff.DEFLATE, zlib.compress(zeros)), (tiff.PACKBITS, tiff.packbits_encode(zeros)), (tiff.LZW, tiff.lzw_encode(zeros[:400_000]))):
        assert 100 <= len(tiff._UNPACK[kind](packed, 100)) < 5000
    good = tiff.write([np.tile(np.arange(200, dtype=np.uint8), (3, 1))], [(tiff.LZW, 1, 0)], "<", 8)
    at = good.index(tiff.lzw_encode(bytes(range(200)) * 3)[:20])
    with pytest.raises(ValueError, match="page 0: part 0: code"):
        list(tiff.read(good[: at + 2] + b"\xff\xfe\xff" + good[at + 5 :]))


def test_tiff_queries(spark):
    texts = [*awkward(), "x" * 64, "x" * 65]
    rows = tiff.text_media(table(spark, texts), keep_file=True)
    for r in rows.collect():
        b = (texts[r["doc_id"]] or "").encode()
        p = b + b"\0" * (-len(b) % 64 if b else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["media_sha256"] == hashlib.sha256(bytes(r["file"])).hexdigest() and r["media_bytes"] == len(r["file"])
    got = {r["doc_id"]: r["feature"] for r in rows.collect()}
    assert got[9].startswith("4 pages 8+32773+5+8 ") and got[1].startswith("1 pages 8 ")
    zero_tile = bytearray(tiff.write([np.zeros((8, 8), np.uint8)], [(tiff.NONE, 1, 16)]))
    at = zero_tile.index(struct.pack("<HHII", tiff.TILE_WIDTH, 4, 1, 16))
    zero_tile[at + 8 : at + 12] = b"\0\0\0\0"
    huge = bytearray(tiff.write([np.zeros((8, 8), np.uint8)], [(tiff.NONE, 1, 0)]))
    for tag in (tiff.WIDTH, tiff.HEIGHT):
        at = huge.index(struct.pack("<HHII", tag, 4, 1, 8))
        huge[at + 8 : at + 12] = b"\xff\xff\xff\xff"
    two = tiff.write([np.ones((4, 4), np.uint8), np.ones((5, 5), np.uint8)], [(tiff.LZW, 1, 0)] * 2)
    cut = bytearray(two)
    cut[cut.rindex(struct.pack("<HHII", tiff.HEIGHT, 4, 1, 5)) + 8] = 200  # the second page asks for more than it holds
    odd = [(900, None), (901, bytearray(b"II*\0\x08\0\0\0")), (902, bytearray(b"no")), (903, zero_tile), (904, huge), (905, cut), (906, bytearray(b"")), (None, bytearray(two))]
    files = rows.select("doc_id", "file").unionByName(spark.createDataFrame(odd, "doc_id long, file binary"))
    pages = defaultdict(list)
    for r in tiff.read_pages(files, "doc_id", "file").collect():
        pages[r["id"]].append(r)
    assert 900 not in pages and all(pages[i][0]["error"] and len(pages[i]) == 1 for i in (901, 902, 903, 904, 906))
    assert [p["error"] is None for p in pages[905]] == [True, False] and [p["height"] for p in pages[None]] == [4, 5]
    for i, t in enumerate(texts):
        assert b"".join(bytes(p["data"]) for p in sorted(pages[i], key=lambda p: p["page"])) == tiff.payload_of(t or "")[1]


def test_tiff_planes_and_fill_order():
    """Files as other writers make them: a plane per sample, bits in reverse."""
    image = np.random.default_rng(3).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    for planar, fill in ((1, 1), (2, 1), (1, 2), (2, 2)):
        parts = [zlib.compress(image[..., i].tobytes()) for i in range(3)] if planar == 2 else [zlib.compress(image.tobytes())]
        parts = [p.translate(tiff._REVERSED) for p in parts] if fill == 2 else parts
        body = b"II*\0\0\0\0\0" + b"".join(parts)
        at = [8 + sum(map(len, parts[:i])) for i in range(len(parts))]
        lists = len(body)
        body += struct.pack(f"<{len(at)}I", *at) + struct.pack(f"<{len(at)}I", *map(len, parts)) + struct.pack("<3H", 8, 8, 8)
        where = lambda k: lists + 4 * len(at) * k if len(at) > 1 else (at[0], len(parts[0]))[k]  # noqa: B023, E731
        tags = [(256, 4, 1, 7), (257, 4, 1, 5), (258, 3, 3, lists + 8 * len(at)), (259, 3, 1, 8), (266, 3, 1, fill), (273, 4, len(at), where(0)), (277, 3, 1, 3), (278, 4, 1, 5), (279, 4, len(at), where(1)), (284, 3, 1, planar)]
        raw = bytearray(body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0")
        raw[4:8] = struct.pack("<I", len(body))
        (page,) = tiff.read(bytes(raw))
        assert page.data == image.tobytes()


def test_secret_base_spans(spark):
    texts = [*awkward(), 'password = "abcdef" token:xyz TOKEN=abcdefg api-key=zzzzzzz apikey: "q1w2e3r4"', "AKIA" + "A1B2" * 5 + " AKIASHORT akia" + "A" * 30, "deadbeef" * 3 + " " + "0" * 23 + " " + "f" * 24, "paßword=123456 to\u212aen=1234567", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B and kJ8fQ2xV0pLz7RtYw3NbHs5DmGc1UeXa9KoTi4"]
    got = {r["doc_id"]: r for r in secrets.scan(table(spark, texts)).collect()}
    n = len(awkward())
    assert (got[n]["n_assign"], got[n + 1]["n_access"], got[n + 2]["n_hex"], got[n + 3]["n_assign"]) == (3, 1, 2, 0)
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[0]["spans"] == ""
    assert got[n + 2]["spans"] == "hex:0:24,hex:49:73"
    assert secrets.scan(table(spark, [])).count() == 0


def test_battery_tells_random_from_structured():
    rng = random.Random(4)
    weights = []
    for _ in range(200):
        run = "".join(rng.choice(secrets.ENCODINGS["base62"]) for _ in range(40))
        weights.append(secrets.weight(*secrets.battery(run, "base62")[1][1:]))
    assert sorted(weights)[20] > 0.5
    for run in ("0123456789abcdef" * 3, "aaaaaaaa11111111aaaaaaaa1111", "ab1" * 12):
        assert secrets.weight(*secrets.battery(run, secrets.encoding_of(run))[1][1:]) < 0.1
    assert secrets.thresholds({(0, 200): 5, (0, 0): 995})[0] == 200 and secrets.thresholds({(0, 0): 10}) == {}
    assert list(secrets.candidates("my_app/" + "a1B2" * 6 + "+x-y")) == [(7, 31, "base62")] and list(secrets.candidates("z" * 20)) == [(0, 20, "lower36")]


def brute_random(texts, level):
    """The battery and plain Benjamini-Hochberg over all p-values of a length class, ranked one by one."""
    alphabet = secrets.ENCODINGS
    corpus = Counter(c for t in texts for c in t or "")
    runs = []
    for i, t in enumerate(texts):
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", t or ""):
            fits = lambda s: next((k for k, a in alphabet.items() if set(s) <= set(a)), None)
            spans = [m.span()] if fits(m.group()) else [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[A-Za-z0-9]{20,}", m.group())]
            runs += [(i, a, b, fits(t[a:b])) for a, b in spans]
    rows = defaultdict(list)
    for i, a, b, name in runs:
        s, letters = texts[i][a:b], alphabet[name]
        n, k = b - a, len(letters)
        total = sum(corpus[c] + 1 for c in letters)
        q = [(corpus[c] + 1) / total for c in letters]
        q2, q3 = sum(x * x for x in q), sum(x**3 for x in q)
        chi = sum((s.count(c) - n / k) ** 2 / (n / k) for c in letters)
        z = (chi - (k * (1 - q2 + n * q2) - n)) / (k * math.sqrt(4 * n * (q3 - q2 * q2) + 2 * (q2 + q2 * q2 - 2 * q3)))
        place = [letters.index(c) for c in s]
        up = [x >= k / 2 for x in place]
        hi, lo = sum(up), n - sum(up)
        if hi and lo:
            mean = 2 * hi * lo / n + 1
            var = (mean - 1) * (mean - 2) / (n - 1)
            p_runs = math.erfc(abs(1 + sum(x != y for x, y in zip(up, up[1:], strict=False)) - mean) / math.sqrt(2 * var)) if var > 0 else 1.0
        else:
            p_runs = 2.0 ** (1 - n)
        centre = sum(place) / n
        dev = [x - centre for x in place]
        var = sum(x * x for x in dev)
        r = sum(x * y for x, y in zip(dev, dev[1:], strict=False)) / var if var else 1.0
        p_serial = math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))
        both = max(p_runs * p_serial, 1e-300)
        fisher = both * (1 - math.log(both))
        rows[sum(n > x for x in secrets.LENGTHS)].append((i, a, b, 0.5 * math.erfc(-max(z, -37) / math.sqrt(2)), fisher / (fisher + 0.01)))
    found = defaultdict(set)
    for of in rows.values():
        mean = sum(w for *_, w in of) / len(of)
        graded = sorted((math.exp(-max(0, math.floor(-math.log(p / (max(w, 1e-300) / mean)) * 20)) / 20), i, a, b) for i, a, b, p, w in of)
        last = max((rank for rank, (p, *_) in enumerate(graded, 1) if p <= level * sum(x[0] <= p for x in graded) / len(graded)), default=0)
        for _, i, a, b in graded[:last]:
            found[i].add((a, b))
    return found


def test_discoveries_equal_plain_ranking(spark):
    rng = random.Random(15)
    symbols = list(secrets.ENCODINGS.values())
    texts = [f"{prose(20, rng)} {''.join(rng.choice(rng.choice(symbols)) for _ in range(rng.randint(20, 70)))} end" for _ in range(60)]
    texts += [f"a {'-'.join(rng.choice(WORDS) for _ in range(rng.randint(6, 20)))} {'x' * rng.randint(1, 40)}" for _ in range(200)]
    texts += [f"k {''.join(rng.choice(symbols[6]) for _ in range(n))} path/{''.join(rng.choice(symbols[6]) for _ in range(n))}/a_b" for n in range(20, 140, 2)]
    texts += [None, "", "abc"] + texts[:3]
    want = brute_random(texts, secrets.LEVEL)
    got = secrets.scan(table(spark, texts)).collect()
    for r in got:
        base = secrets.base_spans(texts[r["doc_id"]] or "")
        new = {s for s in want[r["doc_id"]] if not any(a < s[1] and s[0] < b for a, _, b in base)}
        assert r["spans"] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted([*base, *((a, 3, b) for a, b in new)])) and r["n_random"] == len(new)
    assert len(got) == len(texts) and sum(r["n_random"] for r in got) > 40


def test_random_secrets_stand_out_in_a_corpus(spark):
    rng = random.Random(8)
    fake = ["-".join(rng.choice(WORDS) for _ in range(7)) + str(rng.randint(1, 9)) for _ in range(400)]
    real = ["".join(rng.choice(secrets.ENCODINGS["base62"]) for _ in range(64)) for _ in range(10)]
    rows = secrets.scan(table(spark, [f"see {f} here" for f in fake] + [f"key {r} end" for r in real])).collect()
    hits = {r["doc_id"] for r in rows if r["n_random"]}
    assert {400 + i for i in range(10)} <= hits and len([i for i in hits if i < 400]) <= 4


def brute_languages(rows, texts):
    """Languages by sets of n-grams, letter by letter, without hashes or filters."""
    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
        return [t[i : i + n] for n in langid.ORDERS for i in range(len(t) - n + 1) if " " not in t[i + 1 : i + n - 1]]

    counts = defaultdict(Counter)
    for t, lang in rows:
        counts[lang].update(grams(t))
    total = {k: sum(c.values()) for k, c in counts.items()}
    share = {k: {g: n / total[k] for g, n in c.items() if n >= max(1, total[k] * langid.MIN_SHARE)} for k, c in counts.items()}
    top = Counter()
    for c in share.values():
        for g, x in c.items():
            top[g] = max(top[g], x)
    known = {k: {g for g, x in c.items() if x >= langid.RIVAL * top[g]} for k, c in share.items()}
    out = []
    for t in texts:
        g = grams(t or "")
        cover = {k: sum(x in known[k] for x in g) / len(g) if g else 0 for k in sorted(known)}
        best = max(sorted(cover), key=lambda k: cover[k])
        out.append((best, cover[best] / sum(cover.values()) if sum(cover.values()) else 0.0) if any(c.isalpha() for c in (t or "").lower()) else ("und", 0.0))
    return out


def test_langid_equals_counting_sets(spark):
    """Predictions and scores against sets of n-grams; the filters' false positives are all that may differ, after correction."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in docs.collect() if r["lang"]]
    model = langid.fit(docs)
    texts = [r["text"] for r in rows] + [r["text"][:30] for r in rows if r["text"]] + ["q", "é", "日本", "𝒳", "😀", "😀a", "a1b", "", None, "ß", "İx"]
    got = list(zip(*langid.score_texts(model, [t or "" for t in texts]), strict=True))
    want = brute_languages([(r["text"] or "", r["lang"]) for r in rows], texts)
    for t, g, w in zip(texts, got, want, strict=True):
        assert abs(g[1] - w[1]) < 0.15, t
        assert (g[0] == "und") == (w[0] == "und") and (g[0] == w[0] or w[1] < 0.6), t
    assert sum(g[0] == w[0] for g, w in zip(got, want, strict=True)) >= 0.97 * len(texts)


def test_langid_does_not_depend_on_neighbours(spark):
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    texts = ["q", "the house", "", "der", "😀", "la casa", "x", "schön 𝒳"]
    alone = [langid.score_texts(model, [t]) for t in texts]
    for order in (texts, texts[::-1], texts[3:] + texts[:3]):
        langs, score = langid.score_texts(model, order)
        assert [([a], [b]) for a, b in zip(langs, score, strict=True)] == [alone[texts.index(t)] for t in order]
    assert alone[4] == (["und"], [0.0]) and alone[2] == (["und"], [0.0])


def test_rare_languages_stay_in_the_sample(spark):
    rows = [(i, "common words " * 3, "aa") for i in range(2000)] + [(5000 + i, "zyx wvu", "bb") for i in range(5)] + [(1, "again", "aa")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("gram", F.lit(1)).withColumn("n", F.lit("x"))
    model = langid.fit(df, sample_rows=200)
    assert model.langs == ["aa", "bb"] and langid.score_texts(model, ["zyx"])[0] == ["bb"]


def test_langid(spark):
    rng = random.Random(6)
    tongue = {"aa": "bcdfae", "bb": "rstoui", "cc": "mnpqye"}
    say = lambda lang, n: " ".join("".join(rng.choice(tongue[lang]) for _ in range(rng.randint(3, 7))) for _ in range(n))
    rows = [(i, say(lang, 30), lang) for i, lang in enumerate(rng.choices(sorted(tongue), k=240))] + [(900, say("aa", 20), None), (901, None, "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where(common.crc_mod(F.col("doc_id"), 4) != 2))
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, t, lang in rows[:240])
    assert got[901]["lang_pred"] == "und" and got[900]["lang_pred"] == "aa"
    odd = langid.identify(table(spark, awkward()), model).collect()
    assert {r["doc_id"] for r in odd if r["lang_pred"] == "und"} == {0, 1, 2, 3} and len(odd) == len(awkward())
    kept = langid.keep_identified(table(spark, awkward()), model)
    assert kept.columns == table(spark, []).columns and kept.count() == len(awkward()) - 4
    none = langid.fit(df.limit(0))
    assert [r["lang_pred"] for r in langid.identify(df.limit(1), none).collect()] == ["und"] and langid.identify(df.limit(0), model).count() == 0


def test_toxicity(spark):
    rng = random.Random(12)
    bad = ["zork", "blarg", "snudge"]
    rows = []
    for i in range(400):
        w = prose(rng.randint(5, 80), rng).split()
        y = int(i % 6 == 0)
        if y:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", ".", "!"])
        rows.append((i, " ".join(w), y))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    field = toxicity.fit(df.where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in toxicity.score(df, field).collect()}
    assert all(got[i]["predicted"] == y for i, _, y in rows)
    marked = toxicity.spans(df, field).collect()
    text = {i: t for i, t, _ in rows}
    assert marked and all(text[r["doc_id"]][r["start"] : r["end"]] == r["token"] and r["token"].strip(".!") in bad for r in marked)
    listed = {i: [(int(a), int(b)) for a, b in (x.split(":") for x in got[i]["spans"].split(","))] if got[i]["spans"] else [] for i in got}
    pairs = defaultdict(list)
    for r in marked:
        pairs[r["doc_id"]].append((r["start"], r["end"]))
    assert all(sorted(pairs[i]) == listed[i] and len(listed[i]) == got[i]["n_spans"] for i in got)
    odd = toxicity.score(table(spark, awkward()), field).collect()
    assert len(odd) == len(awkward()) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(df.limit(0), field).count() == 0
    none = toxicity.fit(df.limit(0))
    assert all(r["predicted"] == 0 for r in toxicity.score(df.limit(3), none).collect())


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(7)
    field = toxicity.Field({}, np.zeros((3, 1)), -0.7, np.array([[0.0, -1.1], [0.4, 0.9]]))
    for lens in ([1], [4, 1, 6], [300, 2]):
        n = sum(lens)
        score = rng.normal(size=n)
        first = np.zeros(n, bool)
        first[np.cumsum([0, *lens])[:-1]] = True
        p, _ = toxicity.forward_backward(score, first, field)
        at = 0
        for m in lens:
            s = score[at : at + m]
            a = np.zeros((m, 2))
            a[0] = [0, field.start + s[0]]
            for t in range(1, m):
                a[t] = [np.logaddexp(a[t - 1, 0], a[t - 1, 1] + field.trans[1, 0]), np.logaddexp(a[t - 1, 0] + field.trans[0, 1], a[t - 1, 1] + field.trans[1, 1]) + s[t]]
            b = np.zeros((m, 2))
            for t in range(m - 2, -1, -1):
                b[t] = [np.logaddexp(b[t + 1, 0], field.trans[0, 1] + s[t + 1] + b[t + 1, 1]), np.logaddexp(field.trans[1, 0] + b[t + 1, 0], field.trans[1, 1] + s[t + 1] + b[t + 1, 1])]
            want = 1 / (1 + np.exp((a[:, 0] + b[:, 0]) - (a[:, 1] + b[:, 1])))
            assert np.allclose(p[at : at + m], want, atol=1e-9)
            at += m


def test_licenses(spark):
    t = licenses.TEMPLATES
    rows = [(1, "a/LICENSE", t["MIT"]), (2, "a/b/c.py", "x = 1"), (3, "a/b/d.py", "# " + t["Apache-2.0"] + "\n" + prose(200)), (4, "z/c.py", "x"), (5, "a/b/LICENSE", t["ISC"]), (6, None, None), (7, "a/q/r/s.py", "permission denied by clown")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["own_license"], r["license"], r["license_dir"]) for r in licenses.scan(df, df["path"]).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "ISC", "a/b"), 3: ("Apache-2.0", "Apache-2.0", None), 4: (None, None, None), 5: ("ISC", "ISC", None), 6: (None, None, None), 7: (None, "MIT", "a")}
    assert licenses.scan(df.limit(0), df.limit(0)["path"]).count() == 0


def brute_licenses(rows):
    """TF-IDF with a count of its own for every term, and ancestors walked one by one."""
    t = licenses.templates()
    vocabulary = set().union(*t.counts)
    def joined(text):
        """Paragraphs of several lines, found line by line."""
        out, now, kind = [], [], ""
        for line in [*text.split("\n"), ""]:
            sign = re.match(r"\s*(//|#|/\*|\*)", line)
            bare = line.strip().lstrip("#/* ").removesuffix("*/").strip()
            if now and (not bare or bool(sign) != kind):
                out.append(now)
                now = []
            if bare:
                now, kind = [*now, bare], bool(sign)
        return [" ".join(p) for p in out if len(p) > 1]

    lines = [[licenses.terms(x) for x in [*(r[2] or "").split("\n"), *joined(r[2] or "")] if re.search(licenses.CUE, x.lower())] for r in rows]
    units = {licenses.LINE: [x for ls in lines for x in ls], licenses.BODY: [licenses.terms(r[2]) for r, ls in zip(rows, lines, strict=True) if ls]}
    out = []
    df = {k: Counter(w for u in us for w in set(u)) for k, us in units.items()}

    def cosine(kind, words, counts):
        damp = (lambda n: n) if kind == licenses.LINE else (lambda n: 1 + math.log(n))
        weigh = lambda w: math.log((len(units[kind]) + 1) / (df[kind][w] + 1)) + 1
        a = {w: damp(n) * weigh(w) for w, n in Counter(words).items()}
        b = {w: damp(n) * (weigh(w) if df[kind][w] else 1.0) for w, n in counts.items()}
        norm = lambda x: math.sqrt(sum(v * v for v in x.values()))
        return sum(v * b.get(w, 0) for w, v in a.items()) / norm(a) / norm(b) if a else 0.0

    for r, ls in zip(rows, lines, strict=True):
        every = list(zip(t.names, t.forms, t.counts, strict=True))
        says = lambda n, u: n not in licenses.VERSIONS or any(p + v in u for v in licenses.VERSIONS[n] for p in ("", "v"))
        cue = lambda u: {re.sub("licence", "license", x[0]) for w in u if (x := re.search(licenses.CUE, "public domain" if w == "domain" else w))}
        covers = lambda c, u: sum(w in c for w in u) >= licenses.COVERED * len(u)
        whole = licenses.terms(r[2] or "")
        body = [(round(cosine(licenses.BODY, whole, c), 6), n) for n, f, c in every if f != "short" and covers(c, whole) and says(n, whole) and cue(c) & cue(set(whole) & vocabulary)] if ls else []
        best = max((x for x in body if x[0] >= licenses.FILE_LEAST), default=None)
        file = best is not None
        if not file:
            got = [(round(cosine(licenses.LINE, u, c), 6), n, f) for u in ls for n, f, c in every if f != "text" and says(n, u) and cue(c) & cue(set(u) & vocabulary)]
            best = max(((s, n) for s, n, f in got if s >= (licenses.SHORT_LEAST if f == "short" else licenses.LEAST)), default=None)
        out.append((r[0], r[1], best and best[1], best and best[0], file))
    dirs = defaultdict(list)
    up = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    for _, p, name, score, file in out:
        if file and p is not None:
            dirs[up(p)].append((score, name))
    full = []
    for i, p, name, score, file in out:
        where = up(p) if p is not None and name is None else None
        while where is not None and where not in dirs:
            where = up(where) if where else None
        full.append((i, p, name, score, file, name or (max(dirs[where])[1] if where is not None else None), where))
    return full


def test_licenses_equal_plain_counting(spark):
    """Repeated rows and paths, null paths, texts, ids and empty ones, long texts, files at the root."""
    rng = random.Random(31)
    text = lambda k: (licenses.TEXTS / f"{k}.txt").read_text(encoding="utf-8")
    some = [*licenses.TEMPLATES.values(), *[v for _, v in licenses.SHORT], "the license of a car", "Copyright me", ""]
    rows = [(i, f"{rng.choice('abc')}/{rng.choice('de')}/{i % 7}.py", "\n".join([prose(rng.randint(0, 9), rng), "# " + rng.choice(some), prose(rng.randint(0, 20), rng)])) for i in range(60)]
    rows += [(100, "a/LICENSE", text("MIT")), (101, "a/d/COPYING", text("GPL-3.0")), (102, "a/d/LICENSE", "x\n" + text("Apache-2.0")), (103, None, text("ISC")), (104, None, licenses.TEMPLATES["MIT"]), (105, None, None), (106, "q", None), (107, "q/r", ""), (108, "b/e/long.py", prose(50_000, rng) + "\nLicensed under the MIT license.")]
    rows += [rows[3], rows[60], rows[60], (3, "a/other", "x"), (3, rows[3][1], "y"), (None, "a/z.py", "no id"), (None, "c/z.py", licenses.TEMPLATES["ISC"])]
    for extra in ([], [(200, "LICENSE", text("BSD-3-Clause"))]):
        every = rows + extra
        df = spark.createDataFrame(every, "doc_id long, path string, text string").withColumn("dir", F.lit("x")).withColumn("is_file", F.lit(True)).withColumn("salt", F.lit(1))
        got = licenses.scan(df, df["path"]).collect()
        assert sorted(map(str, near_rows(got))) == sorted(map(str, near_rows(brute_licenses(every))))
        assert sum(r["is_file"] for r in got) >= 5


def near_rows(rows):
    return [(*tuple(r)[:3], r[3] and round(r[3], 4), *tuple(r)[4:]) for r in rows]


def test_usual_headers_over_code(spark):
    """Wrapped headers as they stand over source files, tags, and versions told apart; none of them makes its file a license file."""
    code = "\n\nimport os\n\n\ndef main(argv):\n    for name in argv:\n        print(os.path.basename(name), len(name))\n"
    gpl = lambda v: f"This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; {v}.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    headers = {
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "GPL-2.0": gpl("either version 2 of the License, or\n(at your option) any later version"),
        "GPL-3.0": gpl("either version 3 of the License, or\n(at your option) any later version"),
        "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS.',
        "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    }
    hashed = lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n"))
    starred = lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */"
    slashed = lambda t: "\n".join(f"// {x}".rstrip() for x in t.split("\n"))
    want, rows = {}, []
    for i, (name, text) in enumerate(headers.items()):
        for k, style in enumerate((hashed, starred, slashed)):
            rows.append((10 * i + k, f"src/{i}/{k}.py", style(text) + code))
            want[10 * i + k] = (name, False)
    tags = {"MIT": "// SPDX-License-Identifier: MIT", "GPL-2.0": "/* SPDX-License-Identifier: GPL-2.0-or-later */", "Apache-2.0": "# SPDX-License-Identifier: (Apache-2.0 OR MIT)"}
    for i, (name, text) in enumerate(tags.items()):
        rows.append((900 + i, f"tags/{i}.c", text + code))
        want[900 + i] = (name, False)
    rows.append((990, "src/x.py", hashed("This file is published under the GNU General Public License.") + code))  # no version named
    rows.append((991, "lib/LICENSE", headers["Apache-2.0"].replace("\n\n", "\n")))
    rows.append((992, "lib/a/b.py", code))
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["is_file"]) for r in licenses.scan(df, df["path"]).collect()}
    assert {i: got[i] for i in want} == want
    assert got[990] == (None, False)
    assert got[991] == ("Apache-2.0", False) and got[992][0] is None  # a header alone is no license file


def test_whole_license_files_and_short_lines(spark):
    text = lambda k: (licenses.TEXTS / f"{k}.txt").read_text(encoding="utf-8")
    rows = [(i, f"{k}/LICENSE", "Copyright (c) 2020 Some Body. All rights reserved.\n\n" + text(k)) for i, k in enumerate(("MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0"))]
    rows += [(i + 10, f"{r[1][:-8]}/x/a.py", "x = 1") for i, r in enumerate(rows)]
    rows += [(20, "q/a.txt", prose(100) + "\nLicensed under CC BY-NC 4.0.\n" + prose(100)), (21, "MIT/b.txt", "Licensed under CC BY-NC 4.0."), (22, "w/c.txt", "he lost the license of the car")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["is_file"]) for r in licenses.scan(df, df["path"]).collect()}
    kinds = ("MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0")
    assert [got[i] for i in range(4)] == [(k, True) for k in kinds] and [got[i + 10] for i in range(4)] == [(k, False) for k in kinds]
    assert got[20] == ("CC-BY-NC-4.0", False) and got[21][0] == "CC-BY-NC-4.0" and got[22][0] is None


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    texts = [prose(rng.randint(20, 60), rng) for _ in range(60)]
    texts += [texts[0].upper(), texts[1] + " tail", None, "...", ""]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 2}", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = df
    left = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        left.append({r["doc_id"] for r in docs.collect()})
        assert i == 4 or docs.columns == df.columns
        if i == 2:
            copies = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]})
        elif i == 3:
            assert Counter(r["doc_id"] for r in docs.collect()) == copies
    assert left[0] == set(range(62)) and left[1] == left[0] - {0}
    part = brute_components(sorted(left[1]), [texts[i] for i in sorted(left[1])])
    assert left[2] == {i for i in left[1] if part[i][1] == i}
    assert left[3] <= left[2] and left[4] == left[3]
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))


def odd_rows(spark):
    """Awkward texts under clashing column names, with repeated rows, rows without an id, and an id that stands for two texts."""
    df = table(spark, [*awkward(), "plain words in a row of a table here", "Plain words in a row of a table here"])
    same = table(spark, ["two texts", "one id"], [3, 3])
    none = table(spark, ["no id here", None, "no id here"]).withColumn("doc_id", F.lit(None).cast("long"))
    return df.unionByName(df.where("doc_id in (8, 9, 16)")).unionByName(same).unionByName(none)


OPERATORS = {
    "secrets": lambda df, path: secrets.scan(df),
    "toxicity": lambda df, path: toxicity.score(df, toxicity.fit(df.withColumn("toxic", (F.col("doc_id") % 2).cast("int")))),
    "join": lambda df, path: ngram_join.link_components(df),
    "licenses": lambda df, path: licenses.scan(df, licenses.document_path(df)),
    "bpe": lambda df, path: bpe.digest_documents(df, path),
    "mixing": lambda df, path: mixing.mix(df),
    "tiff": lambda df, path: tiff.text_media(df),
    "dedup": lambda df, path: exact_dedup.exact_dedup(df),
    "langid": lambda df, path: langid.identify(df, langid.fit(df)),
    "wavelet": lambda df, path: wavelet.read_documents(wavelet.write_shards(df, path)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_operator_returns_every_row(spark, name):
    """One row per input row, ids kept, equal rows alike; an empty table gives none."""
    df = odd_rows(spark)
    got = OPERATORS[name](df, queries.tokenizer_path())
    rows = got.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in df.select("doc_id").collect())
    if name not in ("mixing", "wavelet"):  # these give equal rows places of their own
        alike = defaultdict(set)
        for r in rows:
            alike[r["doc_id"]].add(str(r))
        assert all(len(alike[i]) == 1 for i in (8, 9, 16))
    assert OPERATORS[name](df.limit(0), queries.tokenizer_path()).count() == 0


def test_pipeline_stages_of_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    df = odd_rows(spark)
    empty = df.limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for name, docs in (("odd", df), ("empty", empty)):
            out = stage(spark, docs, str(tmp_path))
            assert i == 4 or out.columns == docs.columns
            rows = out.collect()
            assert bool(rows) == (name == "odd")
            if i == 0 and rows:  # what has a letter stays, rows that repeat too
                assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in df.collect() if any(c.isalpha() for c in r["text"] or ""))
            elif i == 1 and rows:
                low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
                assert Counter(low(r["text"]) for r in rows) == Counter({low(r["text"]) for r in df.collect()})
            elif i == 4 and rows:
                assert len(rows) == df.count()


def test_samples_are_bounded_and_stable(spark):
    df = spark.range(10_000)
    a = common.bounded_sample(df, "id", 500)
    assert 350 < a.count() < 650 and a.count() == common.bounded_sample(df, "id", 500).count()


def test_stored_tables_can_be_cleared(spark):
    common.clear_stored(spark)
    kept = common.stored(spark.range(3), "x")
    assert kept.count() == 3 and common.clear_stored(spark) == 1 and common.clear_stored(spark) == 0
