"""Token ids as wavelet matrices: one compressed file per shard with access, counting and occurrence lookup.

A file holds, for a run of consecutive documents, the document ids, the token offsets and the wavelet matrix of all
their ids: one bit-plane per bit of the largest id, most significant first. Each plane keeps the order that results
from moving, stably, all zeros of the plane before in front of its ones.

Layout (little-endian): magic ``LWM2``; uint32 planes; uint64 tokens; uint64 documents; uint64 length of the documents'
frame; per plane its number of zeros (uint64); per plane and block of ``BLOCK`` bits the ones before it in the plane
(uint64) and the length of its frame (uint32); then the zstd frames: documents (ids int64, offsets uint64, a byte per
document that is 0 for a null id), and per block the ones before each of its ``STEP``-bit steps (uint16), then its packed
bits. One token costs a block per plane, whatever the file's size.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.shared import shared_dir

from .bpe import task_encoder
from .common import bound_batches, clear_later, small_batches, stored, tidy, write_file

MAGIC = b"LWM2"  # fixed value of the format
HEAD = struct.Struct("<4sIQQQ")
#: Bits of a compressed block, and of a step of its rank counts.
BLOCK, STEP = 1 << 16, 512
#: Blocks that a reader keeps unpacked.
KEPT_BLOCKS = 256


def pack(doc_ids: np.ndarray, offsets: np.ndarray, ids: np.ndarray, known: np.ndarray | None = None) -> bytes:
    """The file of consecutive documents: ``ids[offsets[i]:offsets[i + 1]]`` are those of ``doc_ids[i]``, which is null where ``known`` is false."""
    n = len(ids)
    k = max(1, int(ids.max()).bit_length()) if n else 1
    blocks = -(-n // BLOCK)
    x = ids.astype(np.uint16 if k <= 16 else np.uint32)
    zstd = zstandard.ZstdCompressor(level=1)
    zeros, before, frames = [], [], []
    for bit in range(k - 1, -1, -1):
        ones = (x & x.dtype.type(1 << bit)).astype(bool)
        padded = np.zeros(blocks * BLOCK // 8, np.uint8)
        packed = np.packbits(ones)
        padded[: len(packed)] = packed
        steps = np.bitwise_count(padded.view(np.uint64)).reshape(blocks, BLOCK // STEP, STEP // 64).sum(2, dtype=np.int64)
        before.append(np.concatenate([[0], np.cumsum(steps.sum(1))])[:blocks])
        ranks = (np.cumsum(steps, axis=1) - steps).astype("<u2")
        for b in range(blocks):
            lo, hi = b * BLOCK // 8, min((b + 1) * BLOCK // 8, len(packed))
            frames.append(zstd.compress(ranks[b].tobytes() + packed[lo:hi].tobytes()))
        low = x[~ones]
        zeros.append(len(low))
        x = np.concatenate([low, x[ones]])
    known = np.ones(len(doc_ids), bool) if known is None else known
    about = zstd.compress(doc_ids.astype("<i8").tobytes() + offsets.astype("<u8").tobytes() + known.astype(np.uint8).tobytes())
    directory = [np.asarray(zeros, "<u8").tobytes(), np.concatenate(before).astype("<u8").tobytes(), np.fromiter(map(len, frames), "<u4", len(frames)).tobytes()]
    return HEAD.pack(MAGIC, k, n, len(doc_ids), len(about)) + b"".join([*directory, about, *frames])


class WaveletFile:
    """Reader of one file. ``access`` reads a token, ``rank`` counts an id before a position, ``select`` finds an occurrence."""

    def __init__(self, data: bytes) -> None:
        magic, self.k, self.n, docs, about = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet file")
        self.data, self.blocks = data, -(-self.n // BLOCK)
        at, many = HEAD.size, self.k * self.blocks
        self.zeros = np.frombuffer(data, "<u8", self.k, at).astype(np.int64)
        self.before = np.frombuffer(data, "<u8", many, at + 8 * self.k).astype(np.int64).reshape(self.k, self.blocks)
        lens = np.frombuffer(data, "<u4", many, at + 8 * (self.k + many)).astype(np.int64)
        at += 8 * (self.k + many) + 4 * many
        self.zstd = zstandard.ZstdDecompressor()
        body = self.zstd.decompress(data[at : at + about])
        self.doc_ids = np.frombuffer(body, "<i8", docs)
        self.offsets = np.frombuffer(body, "<u8", docs + 1, 8 * docs).astype(np.int64)
        self.known = np.frombuffer(body, np.uint8, docs, 8 * (2 * docs + 1)).astype(bool)
        self.frames = at + about + np.concatenate([[0], np.cumsum(lens)])
        self.kept: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def _unpacked(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Rank counts and packed bits of a block."""
        i = level * self.blocks + block
        raw = self.zstd.decompress(self.data[self.frames[i] : self.frames[i + 1]])
        steps = BLOCK // STEP
        return np.frombuffer(raw, "<u2", steps), np.frombuffer(raw, np.uint8, offset=2 * steps)

    def _block(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        i = level * self.blocks + block
        if i in self.kept:
            self.kept.move_to_end(i)
        else:
            self.kept[i] = self._unpacked(level, block)
            if len(self.kept) > KEPT_BLOCKS:
                self.kept.popitem(last=False)
        return self.kept[i]

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position ``i``."""
        if i >= self.n:
            return self.n - int(self.zeros[level])
        block, inside = divmod(i, BLOCK)
        ranks, bits = self._block(level, block)
        step, rest = divmod(inside, STEP)
        part = bits[step * STEP // 8 : step * STEP // 8 + (rest + 7) // 8]
        return int(self.before[level][block]) + int(ranks[step]) + int(np.unpackbits(part, count=rest).sum())

    def _bit(self, level: int, i: int) -> int:
        block, inside = divmod(i, BLOCK)
        return int(self._block(level, block)[1][inside >> 3] >> (7 - (inside & 7))) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.k):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            value = value << 1 | bit
            i = int(self.zeros[level]) + ones if bit else i - ones
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` among the first ``i`` ids."""
        if token < 0 or token >> self.k:
            return 0
        a, b = 0, min(max(i, 0), self.n)
        for level in range(self.k):
            if token >> (self.k - 1 - level) & 1:
                a, b = (int(self.zeros[level]) + self._ones(level, x) for x in (a, b))
            else:
                a, b = a - self._ones(level, a), b - self._ones(level, b)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, nth: int) -> int:
        """Position of the occurrence number ``nth`` (from 0), or -1."""
        if not 0 <= nth < self.count(token):
            return -1
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            if self.rank(token, mid + 1) > nth:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def ids(self) -> np.ndarray:
        """All ids in order, undoing the planes from the last to the first."""
        kind = np.uint16 if self.k <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level in range(self.k - 1, -1, -1):
            plane = [self._unpacked(level, b)[1] for b in range(self.blocks)]
            ones = np.unpackbits(np.concatenate(plane) if plane else np.zeros(0, np.uint8), count=self.n).view(bool)
            y = np.empty(self.n, kind)
            zeros = int(self.zeros[level])
            y[~ones] = x[:zeros]
            y[ones] = x[zeros:] | kind(1 << (self.k - 1 - level))
            x = y
        return x

    def document(self, i: int) -> np.ndarray:
        """Ids of the file's document number ``i`` by access alone."""
        return np.array([self.access(j) for j in range(self.offsets[i], self.offsets[i + 1])], np.int64)


#: Text that is encoded in one go: words repeat within a batch, so wider ones cost less.
BATCH_BYTES = 4 << 20
#: Documents go to ranges of about so many bytes of text.
RANGE_BYTES = 24 << 20
NAME = re.compile(r"(\d+)-(\d+)\.lwm$")


def write_shards(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 20, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Encode, append ``end_id`` to each document and write the files in ascending document order.

    Documents go to ranges of about ``range_bytes`` of text; within a range, files hold whole documents and close at
    ``shard_tokens``. Files are named ``<range>-<shard>.lwm`` in a new folder below the shared one; a task writes each under
    another name and renames it when it is whole, so one that runs again replaces what a lost one left. Returns the files'
    table: ``range int, shard int, n_tokens long, file string``, ``file`` being the file's address.

    Null and empty texts have the end id alone; equal ids keep all their rows, ordered by text; rows with a null id come
    first and keep it; a text may be longer than a range, it is never cut; an empty table gives no file; other columns
    play no part, whatever their names.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    parts = max(1, -(-(src.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // range_bytes))
    ranged = src.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").withColumn("range", F.spark_partition_id())
    folder = f"{shared_dir(spark)}/loam-wavelet-{uuid.uuid4().hex}"
    clear_later(folder)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        here, size, shard = None, 0, 0

        def flush():
            doc, known, lens, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            file = f"{folder}/{here:08d}-{shard:05d}.lwm"
            write_file(file, pack(doc, np.concatenate([[0], np.cumsum(lens)]), ids, known))
            return pa.RecordBatch.from_arrays([pa.array([here], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([file])], names=["range", "shard", "n_tokens", "file"])

        with task_encoder(path) as encoder:
            for batch in small_batches(batches, "text", BATCH_BYTES):
                flat, many = encoder.encode_column(batch.column(1))
                ids = np.insert(flat, np.cumsum(many), end_id)
                many = many + 1
                here, size = batch.column(2)[0].as_py(), size + len(ids)
                held.append((batch.column(0).fill_null(0).to_numpy(), np.asarray(batch.column(0).is_valid()), many, ids))
                if size >= shard_tokens:
                    yield flush()
                    held, size, shard = [], 0, shard + 1
        if held:
            yield flush()

    return stored(ranged.mapInArrow(run, "range int, shard int, n_tokens long, file string"), "wavelet")


def read_documents(files: DataFrame) -> DataFrame:
    """Read every file back: ``doc_id, start, n_tokens, ids_crc32``, one row per document written.

    Starts inside a file come from its offsets; a file's own start is the sum of ``n_tokens`` of all files before it,
    which takes one row per range and per file, not per document. A null id is null again; an empty table gives no row.
    """
    bound_batches(files.sparkSession)
    spark = files.sparkSession
    sizes = files.select("range", "shard", "n_tokens")
    by_range = sizes.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    before = by_range.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("range_start"))
    inside = sizes.select("range", "shard", (F.sum("n_tokens").over(Window.partitionBy("range").orderBy("shard")) - F.col("n_tokens")).alias("shard_start"))
    starts = inside.join(before, "range").select(F.col("range").alias("r"), F.col("shard").alias("s"), (F.col("range_start") + F.col("shard_start")).alias("base"))
    schema = "range int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = WaveletFile(data.as_py())
                view, o = memoryview(f.ids().astype("<u4").tobytes()), f.offsets
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(o[:-1], o[1:], strict=True)]
                k, (r, s) = len(f.doc_ids), map(int, NAME.search(name).groups())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, r), pa.int32()), pa.array(np.full(k, s), pa.int32()), pa.array(f.doc_ids, mask=~f.known), pa.array(o[:-1]), pa.array(np.diff(o)), pa.array(crc, pa.int64())],
                    names=["range", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    first = files.select("file").first()
    if first is None:
        rows = spark.createDataFrame([], schema)
    else:  # the list of files stays distributed: Spark lists the folder
        rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.lwm").load(first["file"].rsplit("/", 1)[0]).select("path", "content").mapInArrow(run, schema)
    return rows.join(starts, (F.col("range") == F.col("r")) & (F.col("shard") == F.col("s"))).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
