"""Several repositories as one: tagged unions, rollups, contracts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Contracts of a block; a table of bits for two blocks takes 32 MB, and a place in a block leaves two of 16 bits free.
BLOCK = 1 << 14
#: Contracts of consumers that a task deals into blocks at once, places of a piece, pairs that are made at once.
EDGES, PIECE, PAIRS = 1 << 20, 1 << 12, 1 << 21
_PIECE = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
_BIT = (1 << np.arange(8)).astype(np.uint8)


def tag_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of members' tables with their ``repo_id``."""
    return reduce(DataFrame.unionByName, [df.withColumn("repo_id", F.lit(k)) for k, df in sorted(parts.items())])


def repo_stats(symbols: DataFrame) -> DataFrame:
    """Per repository: symbols, distinct files and languages."""
    return symbols.groupBy("repo_id").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("file").alias("files"), F.countDistinct("language").alias("languages"))


def worst_staleness(repos: DataFrame) -> DataFrame:
    """Worst level over repositories (``level``)."""
    order = ["fresh", "aging", "stale", "critical"]
    rank = F.create_map(*[x for i, k in enumerate(order) for x in (F.lit(k), F.lit(i))])
    return repos.agg(F.element_at(F.array(*[F.lit(k) for k in order]), F.max(rank[F.col("level")]) + 1).alias("worst"))


def glob_like(pattern: str) -> str:
    """``*`` and ``**`` as LIKE wildcards, others escaped."""
    return pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("**", "*").replace("*", "%")


def partners(edges: DataFrame, hot: int = 512) -> DataFrame:
    """``contract, partners``: how many other contracts share a consumer with it; contracts without one are left out.

    ``edges`` has ``contract`` (whole numbers) and ``consumer``. Contracts fall into blocks of ``BLOCK``; each pair of blocks is a
    table of bits, of a fixed size, that is one task's. What is shuffled is each consumer's contracts in both blocks, two bytes
    each, not the pairs that they make, so a consumer's rows grow with its contracts, not with their square. Consumers of more
    than ``hot`` contracts in a block fill whole rows of bits at once.
    """
    lists = edges.groupBy("consumer").agg(F.collect_list(F.col("contract").cast("long")).alias("contracts"))
    lists = lists.select("contracts", F.col("consumer").isNotNull().alias("known"))  # a filter would go down to the tables, and other uses of ``edges`` would shuffle them again
    pieces = lists.mapInArrow(_pieces, "i long, j long, a binary, b binary")
    counted = pieces.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(lambda batches: _counts(batches, hot), "contract long, partners long")
    own = counted.groupBy("contract").agg((F.sum("partners") - 1).alias("partners"))  # each is its own partner once
    return own.where("partners > 0").select(F.col("contract").cast(edges.schema["contract"].dataType).alias("contract"), "partners")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each two blocks, the places of consumers' contracts in both: 16 bits a place, the highest set at a consumer's first."""
    names = ["i", "j", "a", "b"]
    for batch in _joined(batches):
        lists = batch.column(0).combine_chunks()
        contracts = lists.flatten().to_numpy()
        consumers = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy())
        blocks, at = np.unique(contracts // BLOCK, return_inverse=True)
        order = np.argsort(at.astype(np.int32), kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(blocks) + 1))
        places, consumers = (contracts % BLOCK).astype(np.uint16)[order], consumers[order]
        parts = [(places[x:y], consumers[x:y]) for x, y in pairwise(ends)]
        out, size = [], 0
        for n, (a, of_a) in enumerate(parts):
            here = np.zeros(len(lists), bool)
            here[of_a] = True
            for m in range(n, len(parts)):
                b, of_b = parts[m]
                for x, y in _cut(a, of_a, b, of_b, here, len(lists)) if m > n else _cut(a, of_a, a[:0], of_a[:0], None, 0):
                    out.append((int(blocks[n]), int(blocks[m]), x, y))
                    size += len(x) + len(y)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECE, strict=True)], names=names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECE, strict=True)], names=names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined until they hold ``EDGES`` contracts."""
    held, n = [], 0
    for batch in batches:
        batch = batch.filter(batch.column(1))
        held.append(batch)
        n += len(batch.column(0).flatten())
        if n >= EDGES:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _cut(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, here: np.ndarray | None, n: int) -> Iterator[tuple[bytes, bytes]]:
    """Places of the consumers that both blocks have (of the one block, where ``here`` is none), in pieces of about ``PIECE`` places between consumers."""
    if here is not None:
        there = np.zeros(n, bool)
        there[of_b] = True
        keep_a, keep_b = there[of_a], here[of_b]
        a, of_a, b, of_b = a[keep_a], of_a[keep_a], b[keep_b], of_b[keep_b]
    if not len(a):
        return
    first_a, first_b = (np.concatenate(([True], of[1:] != of[:-1])) if len(of) else np.zeros(0, bool) for of in (of_a, of_b))
    x, y = a | (first_a.astype(np.uint16) << 15), b | (first_b.astype(np.uint16) << 15)
    at_a = np.flatnonzero(first_a)
    at_b = np.flatnonzero(first_b) if len(b) else np.zeros_like(at_a)
    starts = np.flatnonzero(np.diff((at_a + at_b) // PIECE, prepend=-1))
    for s, e in pairwise([*starts, None]):
        end_a, end_b = (len(a), len(b)) if e is None else (at_a[e], at_b[e])
        yield x[at_a[s] : end_a].tobytes(), y[at_b[s] : end_b].tobytes()


def _counts(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """For each two blocks, which follow one another, the bits set in each contract's row, and in its column where the blocks differ."""
    key, table = None, np.zeros((BLOCK, BLOCK // 8), np.uint8)
    for batch in batches:
        keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        starts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))) if batch.num_rows else []
        for s, e in pairwise([*starts, batch.num_rows]):
            if (now := (int(keys[0, s]), int(keys[1, s]))) != key:
                if key:
                    yield from _bits(table, *key)
                    table[:] = 0
                key = now
            a, b = (np.frombuffer(b"".join(batch.column(c).slice(s, e - s).to_pylist()), np.uint16) for c in (2, 3))
            _fill(table, a, b if key[0] != key[1] else a, hot)
    if key:
        yield from _bits(table, *key)


def _bits(table: np.ndarray, i: int, j: int) -> Iterator[pa.RecordBatch]:
    rows = np.bitwise_count(table.view(np.uint64)).sum(axis=1, dtype=np.int64)
    sides = [(i, rows)]
    if i != j:
        columns = np.zeros(BLOCK, np.int64)
        for k in range(0, BLOCK, 255):  # sums of 255 bits fit a byte
            columns += np.unpackbits(table[k : k + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
        sides.append((j, columns))
    for block, counts in sides:
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at + block * BLOCK, pa.int64()), pa.array(counts[at], pa.int64())], names=["contract", "partners"])


def _fill(table: np.ndarray, a: np.ndarray, b: np.ndarray, hot: int) -> None:
    """Set the bits of all pairs of a consumer's places in ``a`` and in ``b``."""
    at_a, at_b = np.flatnonzero(a >> 15), np.flatnonzero(b >> 15)
    n_a, n_b = np.diff(at_a, append=len(a)), np.diff(at_b, append=len(b))
    a, b = (a & (BLOCK - 1)).astype(np.int64), b & (BLOCK - 1)
    large = (n_a > hot) | (n_b > hot)
    for k in np.flatnonzero(large):
        row = np.zeros(BLOCK, np.uint8)
        row[b[at_b[k] : at_b[k] + n_b[k]]] = 1
        row = np.packbits(row, bitorder="little")
        for place in a[at_a[k] : at_a[k] + n_a[k]]:
            table[place] |= row
    times = np.repeat(np.where(large, 0, n_b), n_a)
    begin = np.repeat(at_b, n_a)
    made = np.cumsum(times)
    flat = table.reshape(-1)
    cuts = np.searchsorted(made, np.arange(0, made[-1] if len(made) else 0, PAIRS), side="right")
    for s, e in pairwise([*np.unique(cuts), len(a)]):
        t = times[s:e]
        within = np.arange(t.sum()) + np.repeat(begin[s:e] - (np.cumsum(t) - t), t)
        column = b[within]
        np.bitwise_or.at(flat, np.repeat(a[s:e] * (BLOCK // 8), t) + (column >> 3), _BIT[column & 7])


def contract_points(consumers: Column, transitive: Column, public: Column, breaking: Column) -> tuple[Column, Column]:
    """Risk points and level of a contract: 3 from five consumers, 2 from two; one each for transitive ones, many of them, being public and a breaking change."""
    p = F.when(consumers >= 5, 3).when(consumers >= 2, 2).otherwise(0)
    p = p + F.when(transitive > 0, 1).otherwise(0) + F.when(transitive > 5, 1).otherwise(0) + public.cast("int") + breaking.cast("int")
    return p, F.when(p >= 4, "high").when(p >= 2, "medium").otherwise("low")


def edge_key(contract: Column, consumer: Column, kind: Column, paths: Column) -> Column:
    """First 16 bytes of SHA-256 over the edge's parts and its sorted paths."""
    return F.substring(F.sha2(F.concat_ws("|", contract.cast("string"), consumer.cast("string"), kind, F.array_join(F.array_sort(paths), "|")), 256), 1, 32)


def owners_of(contract_paths: DataFrame, ownership: DataFrame, limit: int = 5) -> DataFrame:
    """Owners by the sum of weight, confidence and specificity over a contract's paths; the top ``limit`` of each contract."""
    from pyspark.sql import Window

    by = contract_paths.join(ownership, "path").groupBy("contract", "owner").agg(F.round(F.sum(F.col("weight") * F.col("confidence") * F.col("specificity")), 6).alias("score"))
    w = Window.partitionBy("contract").orderBy(F.desc("score"), "owner")
    return by.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def tier(confidence: Column) -> Column:
    """Detection tier of an edge."""
    return F.when(confidence >= 0.95, "declared").when(confidence >= 0.7, "derived").when(confidence >= 0.3, "heuristic").otherwise("noise")
