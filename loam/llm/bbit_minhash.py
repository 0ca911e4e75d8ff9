"""Near duplicates by b-bit MinHash: banded candidates, collision-corrected estimates from packed low bits, links confirmed on full sets.

Documents are linked when the Jaccard similarity of their sets of ``WORDS``-word shingles (as 64-bit hashes) is at least 4 / 5.

1. *Signatures.* ``BANDS * ROWS`` minima of a set. A band's minima make its key; of all minima the low ``BITS`` bits are packed
   into bit planes. Equal sets are one node from here on.
2. *Candidates.* Nodes that share a key form a bucket, whose head is the node that lies in the most crowded buckets: among variants
   of one text that is the text itself, or what is nearest to it. Each node is paired with the one head it shares most buckets with. A link shares no key with probability ``(1 - 0.8 ** ROWS) ** BANDS``, below 4e-9.
3. *Estimate.* Two minima's low bits agree with probability ``C + (1 - C) * J``, where ``C = 2 ** -BITS`` is the chance of a
   collision. XOR and bit counts of the planes give the agreement, and pairs are dropped that lie ``ERRORS`` standard errors
   or more below that of a similarity of 0.8.
4. *Links.* The sets decide. Links give components.
5. *Mixed buckets.* Only buckets that still hold several components go on. First their nodes meet those heads that they are
   still apart from. What is mixed even then is searched whole: its nodes, in bands of size, are dealt to pairs of blocks, whose
   task compares the planes and decides by the sets. Variants that are near 0.8 without a link cost a comparison each there,
   but no row of a table.

A bucket of copies or of many variants of one text is one component before step 5 and costs nothing there, whatever its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, bound_batches, small_batches, stored, tidy
from .ngram_join import SET_ROWS, SIM_DEN, SIM_NUM, _bands, _block_pairs, _few, _mix, _pair, _sizes_fit, components, shingle_sets

WORDS = 2
BANDS, ROWS, BITS = 64, 6, 2
#: Longs of one bit plane of a signature.
PLANE = BANDS * ROWS // 64
ERRORS = 6
#: Sets of fewer shingles have no link but with equal ones.
LEAST = SIM_NUM
SALTS = 64
#: Nodes of a block, and shingles of all of them, at most.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
TEXT_BYTES, SLICE = 1 << 20, 128
_FACTOR = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FLIP = _mix(_FACTOR + np.uint64(0x632BE59BD9B4E019))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of a set under each of ``BANDS * ROWS`` hash functions."""
    out = np.full(len(_FACTOR), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), SLICE):
        np.minimum(out, ((shingles[None, at : at + SLICE] ^ _FLIP[:, None]) * _FACTOR[:, None]).min(axis=1), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key a band, different bands never sharing any by construction."""
    banded = (low.reshape(BANDS, ROWS) * _FACTOR[:ROWS]).sum(axis=1, dtype=np.uint64)
    return _mix(banded ^ _FLIP[:BANDS]).view(np.int64)


def planes(low: np.ndarray) -> np.ndarray:
    """The low bits of all minima: plane by plane, 64 minima a long. Minima are mixed first: small ones are alike in their bits."""
    mixed = _mix(low)
    return np.concatenate([np.packbits(((mixed >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.int64) for b in range(BITS)])


def least_agreement(similarity: float = SIM_NUM / SIM_DEN, errors: float = ERRORS) -> int:
    """How many minima must agree in their low bits for a pair to stay."""
    chance = 2.0**-BITS
    p, k = chance + (1 - chance) * similarity, BANDS * ROWS
    return int(np.floor(k * p - errors * np.sqrt(k * p * (1 - p))))


def estimated(agreement):
    """Similarity from the number of minima whose low bits agree, less the chance of collisions."""
    chance = 2.0**-BITS
    return (agreement / (BANDS * ROWS) - chance) / (1 - chance)


def agreeing(a: str, b: str):
    """Agreeing minima of two columns of planes, in the JVM: a minimum agrees if no plane differs in its bit."""

    def differ(i):
        found = F.get(a, i).bitwiseXOR(F.get(b, i))
        for p in range(1, BITS):
            found = found.bitwiseOR(F.get(a, i + p * PLANE).bitwiseXOR(F.get(b, i + p * PLANE)))
        return F.bit_count(found)

    return F.lit(BANDS * ROWS) - F.aggregate(F.sequence(F.lit(0), F.lit(PLANE - 1)), F.lit(0), lambda s, i: s + differ(i))


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, n, digest, keys, planes`` of rows ``doc_id, mark, text``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", TEXT_BYTES):
            sets = shingle_sets(batch.column(2), WORDS)
            digest, keys, bits = [], [], []
            for s in sets:
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                low = minima(s) if len(s) >= LEAST else None
                keys.append(band_keys(low) if low is not None else [])
                bits.append(planes(low) if low is not None else [])
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, lists), pa.array(bits, lists)],
                names=["doc_id", "mark", "n", "digest", "keys", "planes"],
            )

    return docs.mapInArrow(run, "doc_id long, mark long, n long, digest binary, keys array<long>, planes array<long>")


def _nodes(sk: DataFrame) -> DataFrame:
    """``node, digest, doc_id, mark, salts, n, keys, planes``: one row per set, with the smallest of its ids and the salts of all."""
    salt = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {SALTS}) as int))")
    by = sk.where("doc_id is not null and n > 0").groupBy("digest")
    by = by.agg(F.min(F.struct("doc_id", "mark")).alias("one"), F.bit_or(salt).alias("salts"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("planes").alias("planes"))
    # The numbers are written with the rows, so they stay.
    return stored(by.select(F.monotonically_increasing_id().alias("node"), "digest", "one.*", "salts", "n", "keys", "planes"), "nodes")


def _estimates(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b, agree`` of pairs whose sizes and low bits allow a link."""
    about = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("planes").alias(f"p_{x}"))
    both = pairs.join(about("a"), "a").join(about("b"), "b").where(_sizes_fit("n_a", "n_b"))
    return both.select("a", "b", agreeing("p_a", "p_b").alias("agree")).where(F.col("agree") >= least_agreement())


def _sets(ids: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, shingles`` of the nodes in ``ids``. Only their texts are read out; a row that repeats id and text counts once."""
    wanted = stored(_few(ids).join(nodes.select("node", F.col("doc_id").alias("of"), F.col("mark").alias("marked"), "digest"), "node"), "set-texts")
    texts = docs.join(_few(wanted), (F.col("doc_id") == F.col("of")) & (F.col("mark") == F.col("marked"))).select("node", "digest", "text")

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", TEXT_BYTES):
            got = shingle_sets(batch.column(2), WORDS)
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d for s, d in zip(got, batch.column(1).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))], names=["node", "shingles"])
            yield out.filter(pa.array(same, pa.bool_()))

    with batch_rows(docs.sparkSession, SET_ROWS):
        have = stored(texts.mapInArrow(sets, "node long, shingles array<long>"), "sets")
    if have.count() > wanted.count():
        have = stored(have.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    return have


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose full sets are similar enough."""
    have = _sets(stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pair-nodes"), nodes, docs)
    of = lambda x, y: have.select(F.col("node").alias(x), F.col("shingles").alias(y))
    both = pairs.select("a", "b").join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("both"))
    return stored(both.where(F.col("both") * SIM_DEN >= (F.col("nx") + F.col("ny") - F.col("both")) * SIM_NUM).select("a", "b"), "links")


def block_links(label: np.ndarray, bits: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between rows of different labels, as many as it takes to show which labels belong together.

    Sizes and low bits allow a pair or not; allowed pairs are decided by their sets, the likeliest of a row first, until the
    labels of its two rows have become one.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    least, of = least_agreement(), {x: x for x in np.unique(label).tolist()}
    found: list[tuple[int, int]] = []

    def first(x: int) -> int:
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for at in range(0, len(label), SET_ROWS):
        x = slice(at, at + SET_ROWS)
        differ = np.zeros((len(label[x]), len(label), PLANE), np.uint64)
        for p in range(BITS):
            own = slice(p * PLANE, (p + 1) * PLANE)
            differ |= bits[x, None, own] ^ bits[None, :, own]
        agree = BANDS * ROWS - np.bitwise_count(differ).sum(2, dtype=np.int64)
        ok = (agree >= least) & (label[x, None] != label[None, :]) & (np.arange(len(label))[x, None] < np.arange(len(label))[None, :])
        ok &= (size[x, None] * SIM_DEN >= size[None, :] * SIM_NUM) & (size[None, :] * SIM_DEN >= size[x, None] * SIM_NUM)
        i, j = np.nonzero(ok)
        order = np.lexsort((-agree[i, j], i))
        for a, b in zip((i[order] + at).tolist(), j[order].tolist(), strict=True):
            p, q = first(int(label[a])), first(int(label[b]))
            if p != q:
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if both * SIM_DEN >= (size[a] + size[b] - both) * SIM_NUM:
                    of[max(p, q)] = min(p, q)
                    found.append((a, b))
    return found


def _searched(rows: DataFrame) -> DataFrame:
    """Links from rows ``bucket, node, label, planes, shingles``, two blocks a bucket at most."""

    def run(key, batches):
        t = batches if isinstance(batches, pa.Table) else pa.Table.from_batches(batches)
        ids, label = (t.column(c).to_numpy() for c in ("node", "label"))
        bits = t.column("planes").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).view(np.uint64)
        flat = t.column("shingles").combine_chunks()
        ends = flat.offsets.to_numpy()
        every = flat.values.to_numpy().view(np.uint64)
        links = block_links(label, bits, [every[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]) if (label != label[0]).any() else []
        a, b = (np.array([ids[p[k]] for p in links], np.int64) for k in (0, 1))
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return rows.groupBy("bucket").applyInArrow(run, "a long, b long")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the ``label`` of the component of their ``node``, its own number if it has no link."""
    own = labels.select(F.col("id").alias("node"), "label")
    return rows.join(own, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _mixed(member: DataFrame) -> DataFrame:
    """Rows ``key, node, head, m, label`` of the buckets that hold several components, with the component of the head."""
    of_head = F.max(F.when(F.col("node") == F.col("head"), F.col("label")))
    per = member.groupBy("key").agg(of_head.alias("head_label"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return stored(member.join(_few(stored(per.select("key", "head_label"), "mixed")), "key"), "mixed-rows")


def _mixed_links(member: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links inside mixed buckets of more than two nodes; buckets of one largest component are searched together.

    A block holds so many nodes that their sets fit a task; what leaves it are links, not pairs that might be some.
    """
    member = member.where("m > 2")
    per = member.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max_by("label", F.struct("k", -F.col("label"))).alias("major"))
    some = stored(member.join(_few(stored(per, "majors")), "key").select("major", "node", "label").distinct(), "apart")
    sized = stored(_bands(some.join(nodes.select("node", "n"), "node")), "banded")
    group = ["major", "band"]
    leads = sized.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    leads = leads.groupBy(*group).agg(F.max_by("label", F.struct("k", -F.col("label"))).alias("lead"), F.max("k").alias("m"), F.sum("k").alias("all"), F.max("n").alias("n")).where("all > m")
    rows = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / F.col("n"))))
    blocks = stored(leads.select(*group, "lead", F.ceil(F.col("m") / rows).cast("int").alias("mb"), F.ceil((F.col("all") - F.col("m")) / rows).cast("int").alias("ob")), "blocks")
    dealt = sized.join(_few(blocks), group).withColumn("doc_id", F.col("node")).select("node", "label", F.explode(_block_pairs()).alias("pair"), *group)
    dealt = stored(dealt.select(F.xxhash64(*group, "pair").alias("bucket"), "node", "label"), "dealt")
    have = _sets(stored(dealt.select("node").distinct(), "block-nodes"), nodes, docs)
    return _searched(dealt.join(nodes.select("node", "planes"), "node").join(have, "node").select("bucket", "node", "label", "planes", "shingles")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id reachable by links, the row's own if none; ``kept`` marks rows that have it. Texts are
    lower-cased in A-Z; null, empty and blank texts have no shingles and link with nothing. Each row stands for its own text,
    so rows that repeat an id with other texts may be in different components; rows that repeat id and text are alike. Rows
    with a null id have a null component and are no one's link. Texts of any length count whole; an empty table gives none;
    other columns are ignored, whatever their names.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    src = src.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    sk = stored(sketches(src), "signatures")
    nodes = _nodes(sk)

    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    sizes = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
    crowded = stored(keyed.join(_few(sizes), "key"), "crowded")
    about = crowded.groupBy("node").agg(F.sum("m").alias("crowd"))
    heads = crowded.join(about, "node").groupBy("key").agg(F.max(F.struct("crowd", "node")).alias("h"))
    heads = stored(heads.select("key", F.col("h.node").alias("head")), "heads")
    held = stored(crowded.join(_few(heads), "key"), "held")
    shared = held.where("node <> head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.groupBy("node").agg(F.max_by("head", F.struct("shared", "head")).alias("head"))
    tried = stored(best.select(*_pair("node", "head")).distinct(), "best")
    links = _linked(stored(_estimates(tried, nodes), "near"), nodes, src)
    labels = components(links)

    mixed = _mixed(_labelled(held, labels))
    again = stored(mixed.where("label <> head_label").select(*_pair("node", "head")).distinct().join(tried, ["a", "b"], "left_anti"), "again")
    rest = stored(_estimates(again, nodes), "near")
    if not rest.isEmpty():
        links = links.unionByName(_linked(rest, nodes, src))
        labels = components(links)
        mixed = _mixed(_labelled(mixed.drop("label", "head_label"), labels))
    late = stored(_mixed_links(mixed, nodes, src), "late")
    if not late.isEmpty():
        labels = components(links.unionByName(late))

    named = nodes.select("node", "digest", "doc_id", "salts").join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = stored(named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("k")).where("k > 1").select("label", "component_id"), "lowest")
    named = named.join(_few(lowest), "label", "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id"), "salts")
    each = F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1))
    answers = named.select("digest", each.alias("salt"), "component_id")
    rows = sk.select("doc_id", "n", "digest", F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).alias("salt"))
    out = rows.join(answers, ["digest", "salt"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
