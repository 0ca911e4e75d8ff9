"""Jaccard self-join on word shingles with signature trees.

Documents are linked when the Jaccard similarity of their shingle sets is at least 4 / 5. Sets hold 64-bit hashes of
shingles; on these sets the join is exact.

1. *Order.* Shingles that very many documents hold are counted in every task and listed (a bounded list). All documents order
   their shingles alike: unlisted ones by hash, then listed ones. Two linked documents share a shingle among the first
   ``n - ceil(0.8 n) + 1`` of each; those are a document's keys, and the documents with a key form its bucket.
2. *Stars.* A bucket is cut into bands of size: a link spans at most two neighbouring bands, so a document stands in its own
   and in the one below. In each band of a bucket every document is compared with the smallest id, as many pairs as rows.
   Sizes, then bitmaps bound the overlap, the sets themselves decide. Links give components.
3. *More stars.* Buckets with the same largest component are searched together from here on, band by band. In bands that
   hold several components every document is compared with a few picked by hash, some in the largest one and some outside.
4. *Trees.* Bands that still hold several components are cut into blocks of at most ``BLOCK`` documents, and each pair of
   blocks that may hold a link gets a signature tree: leaves of documents, nodes with the OR of their bitmaps, the range of
   set sizes and the component, if it is one. A dual traversal drops node pairs of one component, of sizes too far apart, or
   whose bitmaps allow too small an overlap. What is left is decided by the sets.

Copies of a text, or a thousand variants of one, are one component before step 4 and cost nothing there: blocks of a band's
largest component only meet blocks of other documents. A task holds two blocks, whatever the size of a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, bound_batches, small_batches, stored, tidy

WORDS = 5
#: Similarity as a fraction.
SIM_NUM, SIM_DEN = 4, 5
#: A shingle is listed if tasks that hold it at least ``COUNT_LEAST`` times hold it often enough in all: one that is not listed
#: stands once in nearly every task at most. A task counts batches of about ``COUNT_BYTES`` into a table of ``COUNT_ROWS``,
#: which forgets shingles seen once when it is full.
COUNT_BYTES, COUNT_LEAST, COUNT_ROWS = 2 << 20, 2, 1 << 20
LISTED_LEAST, LISTED_SHARE, LISTED_MOST = 16, 5e-5, 500_000
#: Longer runs of one key are treated like those of listed shingles.
RUN_MOST = 2048
BLOCK = 256
#: Bits of a bitmap for each shingle, at least: of sets up to ``SMALL``, and of larger ones, of which fewer are near each other in
#: size; widest bitmap.
BITS, SMALL, MOST_BITS = (4, 2), 256, 1 << 16
LEAF, FANOUT = 8, 8
#: Documents of a band that all others are compared with before the trees: of its largest component, and of the rest.
PICKED = (5, 2)
#: Pairs of sets are compared in batches of so many: a set may hold a long document's shingles.
SET_ROWS = 64
#: Up to so many ids (8 bytes each) are broadcast.
BROADCAST_IDS = 200_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; with fewer words, of the whole sequence; none without words."""
    clean = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    pieces = pc.ascii_split_whitespace(clean)
    flat = pieces.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    code = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))
    w = code[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    bounds = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    odd = _ODD if words == len(_ODD) else _mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    full = np.zeros(max(0, len(w) - words + 1), np.uint64)
    for j in range(words):
        full += w[j : j + len(full)] * odd[j]
    full = _mix(full)
    empty = np.asarray(pc.equal(pc.binary_length(clean), 0))
    out = []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        n = 0 if empty[i] else b - a
        if n >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif n:
            out.append(_mix((w[a:b] * odd[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def key_count(n: int) -> int:
    """How many of the first shingles a document needs as keys."""
    return n - -(-SIM_NUM * n // SIM_DEN) + 1 if n else 0


def needed(a, b):
    """Least overlap of sets of these sizes for a link."""
    return -(-SIM_NUM * (a + b) // (SIM_NUM + SIM_DEN))


def bitmap(shingles: np.ndarray) -> bytes:
    """One bit per shingle, in a power of two of ``BITS`` to twice as many bits a shingle; larger maps fold onto smaller ones.

    Sets that differ by a quarter in size have maps that differ by one doubling at most.
    """
    wanted = BITS[0] * len(shingles) if len(shingles) <= SMALL else max(BITS[0] * SMALL, BITS[1] * len(shingles))
    n = 256
    while n < wanted and n < MOST_BITS:
        n *= 2
    bits = np.zeros(n, np.uint8)
    bits[((shingles >> np.uint64(20)) & np.uint64(n - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(maps: list[bytes], least: int | None = None) -> np.ndarray:
    """Bitmaps of several sizes as rows of the smallest one (or of ``least`` bytes), by OR."""
    least = least or min(map(len, maps))
    out = np.empty((len(maps), least), np.uint8)
    for i, m in enumerate(maps):
        out[i] = np.bitwise_or.reduce(np.frombuffer(m, np.uint8).reshape(-1, least), axis=0)
    return out.view(np.uint64)


def listed_shingles(docs: DataFrame, rows: int) -> np.ndarray:
    """Hashes of the most common shingles, sorted: only the order of keys depends on it, never a link."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, many = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in small_batches(batches, "text", COUNT_BYTES):
            got, n = np.unique(np.concatenate(shingle_sets(batch.column(1))), return_counts=True)
            at = np.searchsorted(seen, got)
            old = np.zeros(len(got), bool) if not len(seen) else seen[np.minimum(at, len(seen) - 1)] == got
            many[at[old]] += n[old]
            order = np.argsort(whole := np.concatenate([seen, got[~old]]), kind="stable")
            seen, many = whole[order], np.concatenate([many, n[~old]])[order]
            if len(seen) > COUNT_ROWS:
                seen, many = seen[many >= COUNT_LEAST], many[many >= COUNT_LEAST]
        often = many >= COUNT_LEAST
        yield pa.RecordBatch.from_arrays([pa.array(seen[often].view(np.int64)), pa.array(many[often])], names=["shingle", "n"])

    least = max(LISTED_LEAST, int(rows * LISTED_SHARE))
    top = docs.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = top.orderBy(F.desc("n"), "shingle").limit(LISTED_MOST).select("shingle").toPandas()
    return np.sort(top["shingle"].to_numpy(np.int64).view(np.uint64))


def sketches(docs: DataFrame, listed: np.ndarray) -> DataFrame:
    """``doc_id, n, digest, rare, common, bits``: set size, digest of the set, keys outside and inside the list, bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(listed)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in small_batches(batches, "text", COUNT_BYTES):
            sets = shingle_sets(batch.column(1))
            n, digest, rare, often, bits = [], [], [], [], []
            for s in sets:
                k = key_count(len(s))
                if len(common) and len(s):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    is_common = common[at] == s
                    first = s[~is_common][:k]
                    rest = s[is_common][: k - len(first)]
                else:
                    first, rest = s[:k], s[:0]
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                rare.append(first.view(np.int64))
                often.append(rest.view(np.int64))
                bits.append(bitmap(s))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(rare, lists), pa.array(often, lists), pa.array(bits, pa.binary())], names=["doc_id", "n", "digest", "rare", "common", "bits"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, rare array<long>, common array<long>, bits binary")


def _buckets(keys: DataFrame) -> DataFrame:
    """Buckets of two or more ids from rows ``key, doc_id``, sorted by both inside each partition: ``docs`` ascending, or, for long runs, rows ``key, doc_id``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_left, doc_left, long_key = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def cut(key: np.ndarray, doc: np.ndarray, closed: bool):
            nonlocal key_left, doc_left, long_key
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            keep = len(starts) if closed else len(starts) - 1
            lists, keys_out, docs_out = [], [], []
            for a, b in zip(starts[:keep], ends[:keep], strict=True):
                if b - a < 2 and key[a] != long_key:
                    continue
                if key[a] == long_key or b - a > RUN_MOST:
                    keys_out.append(key[a:b])
                    docs_out.append(doc[a:b])
                else:
                    ids = np.unique(doc[a:b])
                    if len(ids) > 1:
                        lists.append(ids)
            if not closed:
                a = starts[-1]
                if len(key) - a > RUN_MOST or key[a] == long_key:
                    long_key = key[a]
                    keys_out.append(key[a:])
                    docs_out.append(doc[a:])
                    key_left, doc_left = key[:0], doc[:0]
                else:
                    key_left, doc_left = key[a:], doc[a:]
            n = sum(map(len, docs_out))
            flat_keys = np.concatenate(keys_out) if n else np.zeros(0, np.int64)
            flat_docs = np.concatenate(docs_out) if n else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([*lists, *[None] * n], pa.list_(pa.int64())), pa.concat_arrays([pa.nulls(len(lists), pa.int64()), pa.array(flat_keys)]), pa.concat_arrays([pa.nulls(len(lists), pa.int64()), pa.array(flat_docs)])],
                names=["docs", "key", "doc_id"],
            )

        for batch in batches:
            if batch.num_rows:
                key = np.concatenate([key_left, batch.column(0).to_numpy()])
                doc = np.concatenate([doc_left, batch.column(1).to_numpy()])
                yield cut(key, doc, False)
        if len(key_left):
            yield cut(key_left, doc_left, True)

    return keys.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(run, "docs array<long>, key long, doc_id long")


def _bands(rows: DataFrame) -> DataFrame:
    """``rows`` with a size ``n``, once in the ``band`` of that size and once in the one below: two sizes that allow a link share a band."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(SIM_DEN / SIM_NUM) + 1e-9)).cast("int")
    return rows.withColumn("band", F.explode(F.array(band, band - 1)))


def _sizes_fit(a: str, b: str):
    return (F.col(a) * SIM_DEN >= F.col(b) * SIM_NUM) & (F.col(b) * SIM_DEN >= F.col(a) * SIM_NUM)


def _few(rows: DataFrame) -> DataFrame:
    """A stored table of single rows, to be broadcast if it is short."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _pair(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``doc_id`` is among the stored ``ids`` (column ``id``): few ids are broadcast, many are joined."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col("doc_id") == F.col("id"), "left_semi")


def _bounded(pairs: DataFrame, sk: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose bitmaps allow a link; ``same`` if the sets are equal."""
    some = _only(sk, stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids"))
    about = lambda x: some.select(F.col("doc_id").alias(x), F.struct("n", "digest", "bits").alias(f"of_{x}"))
    both = pairs.join(about("a"), "a").join(about("b"), "b")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).flatten(), batch.column(3).flatten()
            na, nb = x[0].to_pylist(), y[0].to_pylist()
            same = [p == q for p, q in zip(x[1].to_pylist(), y[1].to_pylist(), strict=True)]
            keep = []
            for i, (p, q) in enumerate(zip(x[2].to_pylist(), y[2].to_pylist(), strict=True)):
                m = fold([p, q])
                shared = int(np.bitwise_count(m[0] & m[1]).sum())
                most = min(na[i] - int(np.bitwise_count(m[0]).sum()), nb[i] - int(np.bitwise_count(m[1]).sum())) + shared
                keep.append(same[i] or most >= needed(na[i], nb[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.bool_())], names=["a", "b", "same"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long, same boolean")


def _decided(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that are linked, by their sets. Only documents in a pair are read out; few ids are broadcast, many are joined."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    if ids.isEmpty():
        return pairs.select("a", "b")
    wanted = _only(docs, ids)

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            got = [s.tobytes() for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["doc_id", "shingles"])

    with batch_rows(docs.sparkSession, SET_ROWS):
        have = stored(wanted.mapInArrow(sets, "doc_id long, shingles binary"), "sets")
    both = pairs.select("a", "b").join(have.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(have.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(SIM_DEN * shared >= SIM_NUM * (len(x) + len(y) - shared) and shared > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with batch_rows(docs.sparkSession, SET_ROWS):
        return stored(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "decided")


def components(links: DataFrame) -> DataFrame:
    """``id, label`` for every id in links ``a, b``: the smallest id reachable. Labels fall along links, then along labels, until none changes."""
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    labels = links.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "id").unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("label")))
    labels = stored(labels.groupBy("id").agg(F.min("label").alias("label")), "labels")
    while True:
        of = lambda x, y: links.join(labels.withColumnRenamed("label", "seen"), F.col(x) == F.col("id")).select(F.col(y).alias("id"), F.col("seen").alias("label"))  # noqa: B023, E731
        near = labels.unionByName(of("a", "b")).unionByName(of("b", "a")).groupBy("id").agg(F.min("label").alias("label"))
        near = stored(near, "near")
        jump = near.alias("n").join(near.select(F.col("id").alias("at"), F.col("label").alias("far")), F.col("label") == F.col("at"), "left")
        new = stored(jump.select("id", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        moved = new.join(labels.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count()
        labels = new
        if not moved:
            return labels


class Node:
    """A tree node: rows below it, OR of bitmaps, size range, ``slack`` (most shingles a bitmap hides), component or -1."""

    __slots__ = ("rows", "kids", "bits", "low", "high", "slack", "comp")

    def __init__(self, rows: np.ndarray, kids: list[Node], bits, low, high, slack, comp) -> None:
        self.rows, self.kids, self.bits, self.low, self.high, self.slack, self.comp = rows, kids, bits, low, high, slack, comp


def build(size: np.ndarray, maps: np.ndarray, comp: np.ndarray) -> Node:
    """Tree over documents in order of component and size, so that nodes are alike."""
    order = np.lexsort((size, comp))
    slack = size - np.bitwise_count(maps).sum(1)
    level = []
    for at in range(0, len(order), LEAF):
        r = order[at : at + LEAF]
        one = comp[r[0]] if (comp[r] == comp[r[0]]).all() else -1
        level.append(Node(r, [], np.bitwise_or.reduce(maps[r], axis=0), size[r].min(), size[r].max(), slack[r].max(), one))
    while len(level) > 1:
        up = []
        for at in range(0, len(level), FANOUT):
            k = level[at : at + FANOUT]
            one = k[0].comp if all(x.comp == k[0].comp for x in k) else -1
            up.append(Node(order[:0], k, np.bitwise_or.reduce([x.bits for x in k], axis=0), min(x.low for x in k), max(x.high for x in k), max(x.slack for x in k), one))
        level = up
    return level[0]


def dual(root: Node, size: np.ndarray, maps: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Row pairs of different components that sizes and bitmaps allow to be linked."""
    found, todo = [], [(root, root)]
    while todo:
        x, y = todo.pop()
        if x.comp == y.comp != -1 or x.high * SIM_DEN < y.low * SIM_NUM or y.high * SIM_DEN < x.low * SIM_NUM:
            continue
        if x is not y and min(x.slack, y.slack) + int(np.bitwise_count(x.bits & y.bits).sum()) < needed(x.low, y.low):
            continue
        if x.kids or y.kids:
            if x is y:
                todo += [(k, m) for i, k in enumerate(x.kids) for m in x.kids[i:]]
            elif x.kids and (not y.kids or x.high >= y.high):
                todo += [(k, y) for k in x.kids]
            else:
                todo += [(x, k) for k in y.kids]
            continue
        a, b = (g.ravel() for g in np.meshgrid(x.rows, y.rows, indexing="ij"))
        ok = (comp[a] != comp[b]) & (size[a] * SIM_DEN >= size[b] * SIM_NUM) & (size[b] * SIM_DEN >= size[a] * SIM_NUM)
        if x is y:
            ok &= a < b
        a, b = a[ok], b[ok]
        if len(a):
            shared = np.bitwise_count(maps[a] & maps[b]).sum(1)
            pop = np.bitwise_count(maps).sum(1)
            most = np.minimum(size[a] - pop[a], size[b] - pop[b]) + shared
            good = most >= needed(size[a], size[b])
            found += zip(a[good].tolist(), b[good].tolist(), strict=True)
    return found


def tree_join(size: np.ndarray, raw: list[bytes], comp: np.ndarray) -> list[tuple[int, int]]:
    """Row pairs that may be linked. Sizes within a link differ by a quarter at most, so bitmaps by one doubling at most:
    a tree for each bitmap size holds the documents of that size and, folded, of the next one."""
    wide = np.fromiter(map(len, raw), np.int64, len(raw))
    found = []
    for w in np.unique(wide):
        rows = np.flatnonzero((wide == w) | (wide == 2 * w))
        if len(rows) < 2 or (comp[rows] == comp[rows[0]]).all():
            continue
        maps = fold([raw[i] for i in rows], int(w))
        pairs = dual(build(size[rows], maps, comp[rows]), size[rows], maps, comp[rows])
        found += [(rows[i], rows[j]) for i, j in pairs if wide[rows[i]] == w or wide[rows[j]] == w]
    return found


def _block_pairs() -> F.Column:
    """Names of the pairs of blocks that a document of a band belongs to: blocks of the largest component meet those of other
    documents, which meet each other too; a band of no more than two blocks is one."""
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    name = lambda kind, i, j: F.concat_ws("-", F.lit(kind), i.cast("string"), j.cast("string"))
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    major = F.transform(up_to("ob"), lambda j: name("m", block("mb"), j))
    meets = F.when(F.col("mb") > 0, F.transform(up_to("mb"), lambda i: name("m", i, block("ob")))).otherwise(F.array().cast("array<string>"))
    among = F.transform(up_to("ob"), lambda j: name("o", F.least(j, block("ob")), F.greatest(j, block("ob"))))
    whole = F.array(F.lit("all"))
    return F.when(F.col("mb") + F.col("ob") <= 2, whole).when(F.col("label") == F.col("lead"), major).otherwise(F.concat(meets, among))


def _tree_pairs(rows: DataFrame) -> DataFrame:
    """Candidate pairs from rows ``bucket, doc_id, label, n, bits`` by one tree a bucket, which holds two blocks at most."""

    def run(key, batches):
        t = pa.Table.from_batches(batches) if not isinstance(batches, pa.Table) else batches
        size, comp, ids = (t.column(c).to_numpy() for c in ("n", "label", "doc_id"))
        raw = t.column("bits").to_pylist()
        pairs = tree_join(size, raw, comp) if (comp != comp[0]).any() else []
        a = np.array([ids[i] for i, _ in pairs], np.int64)
        b = np.array([ids[j] for _, j in pairs], np.int64)
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return rows.groupBy("bucket").applyInArrow(run, "a long, b long")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    ``component_id`` is the smallest id reachable by links, the document's own if none. Texts are lower-cased in A-Z; null,
    empty and blank texts have no shingles and link with nothing. Rows that share an id are one document with each row's
    links. Rows with a null id are returned with their size and a null component. Texts of any length count whole; an empty
    table gives none; other columns are ignored, whatever their names.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    listed = listed_shingles(src, src.count())
    sk = stored(sketches(src, listed), "sketches")
    every = sk.where("doc_id is not null and n > 0")
    # Equal sets are linked by their digests; one document stands for them in all that follows.
    copies = every.groupBy(F.col("digest").alias("g")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    copies = stored(copies.select("g", "first"), "copies")
    known = every.join(_few(copies), F.col("digest") == F.col("g"), "left").where("first is null or doc_id = first").drop("g", "first")

    # Buckets of unlisted keys; equal buckets count once.
    runs = stored(_buckets(known.select(F.explode("rare").alias("key"), "doc_id")), "runs")
    buckets = stored(runs.where("docs is not null").select("docs").distinct().withColumn("bucket", F.xxhash64("docs")), "buckets")
    dense = runs.where("docs is null").select("key", "doc_id").unionByName(known.select(F.explode("common").alias("key"), "doc_id"))
    dense = dense.distinct().select(F.xxhash64(F.lit("key"), "key").alias("bucket"), "doc_id")
    light = buckets.select("bucket", F.explode("docs").alias("doc_id"))
    sizes = known.select(F.col("doc_id").alias("sid"), "n")
    keyed = stored(light.unionByName(dense).join(sizes, F.col("doc_id") == F.col("sid")).select("bucket", "doc_id", "n"), "keyed")

    # Stars.
    banded = _bands(keyed)
    heads = banded.groupBy("bucket", "band").agg(F.min(F.struct("doc_id", "n")).alias("h"), F.max("doc_id").alias("top")).where("h.doc_id <> top")
    heads = stored(heads.select("bucket", "band", F.col("h.doc_id").alias("head"), F.col("h.n").alias("head_n")), "heads")
    near = banded.join(_few(heads), ["bucket", "band"]).where((F.col("doc_id") != F.col("head")) & _sizes_fit("n", "head_n")).select(*_pair("doc_id", "head"))
    near = stored(near.distinct(), "near")
    tried = stored(_bounded(near, known), "stars")
    links = _decided(tried.where("not same"), src).unionByName(tried.where("same").select("a", "b")).unionByName(_twins(every))
    links = stored(links, "star-links")
    labels = components(links)

    # More stars, in the bands of the buckets that hold several components still, by their largest one.
    labelled = lambda rows: rows.join(labels.withColumnRenamed("id", "lid"), F.col("doc_id") == F.col("lid"), "left").withColumn("label", F.coalesce("label", "doc_id")).drop("lid")
    member = stored(labelled(keyed), "member")
    per = member.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("bucket").agg(F.max_by("label", F.struct("m", -F.col("label"))).alias("major"), F.count(F.lit(1)).alias("parts"))
    mixed = stored(per.where("parts > 1").select("bucket", "major"), "mixed")
    held = stored(_bands(member.join(mixed, "bucket").select("major", "doc_id", "n").distinct()), "held")
    group = ["major", "band"]
    some = stored(labelled(held), "labelled")
    leads = lambda rows: rows.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("k")).groupBy(*group).agg(F.max_by("label", F.struct("k", -F.col("label"))).alias("lead"), F.max("k").alias("m"), F.sum("k").alias("all")).where("all > m")
    pick = lambda inside, k: F.min_by(F.struct("doc_id", "n", "label"), F.when((F.col("label") == F.col("lead")) == inside, F.xxhash64(F.lit(k), "doc_id")))
    picks = F.array(*[pick(True, k) for k in range(PICKED[0])], *[pick(False, k) for k in range(PICKED[1])])
    picked = some.join(leads(some), group).groupBy(*group).agg(F.array_distinct(picks).alias("p")).select(*group, F.explode("p").alias("p"))
    picked = stored(picked.select(*group, F.col("p.doc_id").alias("head"), F.col("p.n").alias("head_n"), F.col("p.label").alias("head_label")), "picked")
    again = some.join(_few(picked), group).where((F.col("label") != F.col("head_label")) & _sizes_fit("n", "head_n")).select(*_pair("doc_id", "head"))
    again = stored(again.distinct().join(near, ["a", "b"], "left_anti"), "again")
    if not again.isEmpty():
        near = near.unionByName(again)
        links = stored(links.unionByName(_decided(stored(_bounded(again, known), "bounded"), src)), "more-links")
        labels = components(links)

    # Trees over what holds several components even now.
    some = stored(labelled(held), "labelled")
    blocks = leads(some).select(*group, "lead", F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil((F.col("all") - F.col("m")) / BLOCK).cast("int").alias("ob"))
    dealt = some.join(stored(blocks, "blocks"), group).select("doc_id", "label", F.explode(_block_pairs()).alias("pair"), *group)
    dealt = stored(dealt.select(F.xxhash64(*group, "pair").alias("bucket"), "doc_id", "label"), "dealt")
    about = _only(known, stored(dealt.select(F.col("doc_id").alias("id")).distinct(), "tree-ids")).select(F.col("doc_id").alias("sid"), "n", "bits")
    full = dealt.join(about, F.col("doc_id") == F.col("sid")).select("bucket", "doc_id", "label", "n", "bits")
    more = stored(_tree_pairs(full).distinct().join(near, ["a", "b"], "left_anti"), "tree-pairs")
    if not more.isEmpty():
        late = stored(_decided(more, src), "tree-links")
        if not late.isEmpty():
            labels = components(links.unionByName(late))
    out = sk.select("doc_id", F.col("n").alias("n_shingles"))
    return out.join(labels.withColumnRenamed("id", "lid"), F.col("doc_id") == F.col("lid"), "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def _twins(known: DataFrame) -> DataFrame:
    """Links between documents of equal sets: a star per salted group, and one over the groups' smallest ids."""
    salted = known.select("doc_id", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("salt"))
    heads = salted.groupBy("digest", "salt").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("z"))
    inner = salted.join(heads.where("b <> z").select("digest", "salt", "b"), ["digest", "salt"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    top = heads.groupBy("digest").agg(F.min("b").alias("c"), F.max("b").alias("z")).where("c <> z")
    outer = heads.join(top.select("digest", "c"), "digest").where("b <> c").select(F.col("b").alias("a"), F.col("c").alias("b"))
    return inner.unionByName(outer)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one document per component stays: the one with the smallest id.

    Up to ``BROADCAST_IDS`` ids that go are broadcast, more are joined. Rows with a null id stay.
    """
    parts = link_components(docs, id_col, text_col)
    gone = stored(parts.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
