"""A search index that is kept current: immutable segments, tombstones, merges by size, reads of a named snapshot.

A folder holds

* ``segments/<name>/postings``: ``term, field, id, tf, positions, length``, in ranges of ``term``: a term, or all terms with a
  prefix, are a slice of few files, which Parquet's minima and maxima single out;
* ``segments/<name>/grams``: ``gram, first, ids`` for every place's next three letters (fewer at the end), in ranges of ``gram``:
  a gram has several lists of ids, each of some neighbouring rows, and ``first`` is the first id of a list;
* ``segments/<name>/texts``: the fields themselves, dealt to ``part`` folders by a hash of the id;
* ``segments/<name>/gone``: ids whose rows in earlier segments are dead;
* ``manifests/<version>.json``: the segments of a snapshot in order, and its number of live rows and tokens.

A batch of rows becomes one segment, whatever the index holds already. Runs of at least ``FANIN`` neighbouring segments of a
like size are merged into one, so there are about as many segments as the logarithm of the rows, and a row is rewritten that
often. Old segments and manifests stay until :func:`vacuum`, so a reader of an older version is not disturbed.
"""

from __future__ import annotations

import contextlib
import json
import math
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import files
from loam.functions.shared import shared_dir
from loam.operators.search import tokens

#: Indexes that this process has built, with their seconds, for reports.
BUILDS: list[tuple[str, float]] = []
FANIN = 4
PARTS = 64
GRAM = 3
#: Tokens of a text in lower case, as ``operators.search.tokens`` cuts them.
_TOKEN = re.compile("[a-z0-9_]+")
#: Rows, or positions, of an Arrow batch.
ROWS = 100_000
#: Characters of text whose grams are sorted at once.
CHARS = 1 << 22
#: Of the files; an index of another layout is not opened.
LAYOUT = 2


@dataclass(frozen=True)
class Snapshot:
    """One version of an index."""

    spark: SparkSession
    root: str
    version: int
    fields: dict[str, float]
    parts: int
    segments: tuple[dict, ...]
    docs: int
    tokens: int

    @property
    def mean(self) -> float:
        """Mean tokens of a live row."""
        return self.tokens / self.docs if self.docs else 0.0

    def table(self, kind: str) -> DataFrame | None:
        """All segments' rows with their segment's place ``seg``; nothing if no segment has any."""
        found = [self.spark.read.parquet(f"{self.root}/segments/{s['name']}/{kind}").withColumn("seg", F.lit(i)) for i, s in enumerate(self.segments) if s["gone" if kind == "gone" else "rows"]]
        out = None
        for df in found:
            out = df if out is None else out.unionByName(df)
        return out

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows of segments whose id no later segment has replaced or deleted."""
        gone = self.table("gone")
        if gone is None:
            return rows
        last = gone.groupBy(F.col("id").alias("gone_id")).agg(F.max("seg").alias("gone_at"))
        return rows.join(last, (F.col("id") == F.col("gone_id")) & (F.col("seg") < F.col("gone_at")), "left_anti")


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in files.names(spark, f"{root}/manifests") if n.endswith(".json")]


def open_index(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """A snapshot by its version, or the latest."""
    m = json.loads(files.read_text(spark, f"{root}/manifests/{max(versions(spark, root)) if version is None else version:012d}.json"))
    return Snapshot(spark, root, m["version"], m["fields"], m["parts"], tuple(m["segments"]), m["docs"], m["tokens"])


def _commit(spark: SparkSession, root: str, version: int, fields: dict, parts: int, segments: list[dict], docs: int, toks: int) -> Snapshot:
    m = {"version": version, "fields": fields, "parts": parts, "segments": segments, "docs": docs, "tokens": toks}
    files.create_text(spark, f"{root}/manifests/{version:012d}.json", json.dumps(m))
    return open_index(spark, root, version)


def create(spark: SparkSession, root: str, fields: dict[str, float], parts: int = PARTS) -> Snapshot:
    """An empty index of text ``fields`` with their weights."""
    return _commit(spark, root, 0, fields, parts, [], 0, 0)


def _part(parts: int):
    return F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")


def _postings(texts: DataFrame, fields: dict) -> DataFrame:
    """``term, field, id, length, tf, positions``: a text's tokens are gathered by term inside their row, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for field, column in enumerate(batch.columns[2:]):
                terms, own, sizes, places, counts = [], [], [], [], []
                for i, length, text in zip(ids, lengths, column, strict=True):
                    if not text.is_valid:
                        continue
                    at: dict[str, list[int]] = {}
                    for place, term in enumerate(_TOKEN.findall(text.as_py())):
                        at.setdefault(term, []).append(place)
                    terms += at
                    own += [i] * len(at)
                    sizes += [length] * len(at)
                    for found in at.values():
                        places += found
                        counts.append(len(found))
                    if len(places) > ROWS:
                        yield _posting_rows(terms, field, own, sizes, counts, places)
                        terms, own, sizes, places, counts = [], [], [], [], []
                if terms:
                    yield _posting_rows(terms, field, own, sizes, counts, places)

    lowered = [F.lower(F.col(c)).alias(c) for c in fields]
    return texts.select("id", "length", *lowered).mapInArrow(run, "term string, field int, id long, length long, tf long, positions array<int>")


def _posting_rows(terms: list, field: int, ids: list, lengths: list, counts: list, places: list) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(offsets), pa.array(places, pa.int32()))
    columns = [pa.array(terms, pa.string()), pa.array([field] * len(terms), pa.int32()), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(counts, pa.int64()), positions]
    return pa.RecordBatch.from_arrays(columns, names=["term", "field", "id", "length", "tf", "positions"])


def _gram_lists(texts: DataFrame, fields: dict) -> DataFrame:
    """``gram, first, ids``: every place's next ``GRAM`` characters, also at the end where there are fewer, with the rows that have them; a gram has one list, of which ``first`` is the first id, for about ``CHARS`` characters of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(pc.fill_null(pc.utf8_length(c), 0).to_numpy().astype(np.int64) for c in batch.columns[1:])
            cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // CHARS, prepend=-1))
            parts = [batch.slice(x, y - x) for x, y in pairwise([*cuts, batch.num_rows])]
            while parts:
                part = parts.pop()
                lists = _lists_of(part)
                if lists is None:  # too many rows and characters for one number
                    parts += [part.slice(0, part.num_rows // 2), part.slice(part.num_rows // 2)]
                elif lists.num_rows:
                    yield lists

    return texts.select("id", *fields).mapInArrow(run, "gram string, first long, ids array<long>")


def _lists_of(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """A batch's grams, A-Z in lower case, with the ids of their rows. A gram and a row are one number; nothing if that does not fit."""
    columns = [c.to_pylist() for c in batch.columns[1:]]
    lengths = np.concatenate([np.fromiter(map(len, (t or "" for t in c)), np.int64, batch.num_rows) for c in columns])
    codes = np.frombuffer("".join(t or "" for c in columns for t in c).encode("utf-32-le"), np.uint32)
    codes = codes + 32 * ((codes >= 65) & (codes <= 90)).astype(np.uint32)
    number = np.zeros(0x110000, np.int64)
    number[codes] = 1
    chars = np.flatnonzero(number)
    number[chars] = np.arange(1, len(chars) + 1)
    base, bits = len(chars) + 1, max(1, batch.num_rows - 1).bit_length()
    if base**GRAM << bits >= 1 << 63:
        return None
    place = np.arange(len(codes)) + np.repeat((GRAM - 1) * np.arange(len(lengths)), lengths)  # room for ends between texts
    padded = np.zeros(len(codes) + (GRAM - 1) * len(lengths), np.int64)
    padded[place] = number[codes]
    grams = np.zeros(len(codes), np.int64)
    for k in range(GRAM):
        grams = grams * base + padded[place + k]
    both = grams << bits | np.repeat(np.tile(np.arange(batch.num_rows), len(columns)), lengths)
    both.sort()
    both = both[np.diff(both, prepend=-1) != 0]
    grams, rows = both >> bits, both & ((1 << bits) - 1)
    starts = np.flatnonzero(np.diff(grams, prepend=-1))
    letters = np.array(["", *map(chr, chars)], object)
    names = np.full(len(starts), "", object)
    for k in reversed(range(GRAM)):
        names = names + letters[grams[starts] // base**k % base]
    ids = batch.column(0).to_numpy()[rows]
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids[starts], pa.int64()), lists], names=["gram", "first", "ids"])


def gram_rows(lists: DataFrame) -> DataFrame:
    """A row for each id of the lists."""
    return lists.withColumn("id", F.explode("ids")).drop("first", "ids")


def _grams(texts: DataFrame, fields: dict) -> DataFrame:
    """``gram, id``, each once."""
    return gram_rows(_gram_lists(texts, fields))


def _listed(rows: DataFrame) -> DataFrame:
    """Lists of rows of ``gram, id``, for ranges of ``ROWS`` ids."""
    lists = rows.groupBy("gram", F.floor(F.col("id") / ROWS)).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return lists.select("gram", F.get("ids", F.lit(0)).alias("first"), "ids")


def _ranged(rows: DataFrame, *order: str) -> DataFrame:
    """Sorted ranges: a very common term spreads over several files, as the id is part of the order."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _write(df: DataFrame, path: str, *by: str) -> None:
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def _segment(root: str, texts: DataFrame | None, postings: DataFrame | None, grams: DataFrame | None, gone: DataFrame | None) -> dict:
    name = uuid.uuid4().hex
    at = f"{root}/segments/{name}"
    made = {"name": name, "rows": 0, "gone": 0, "tokens": 0}
    if gone is not None:
        _write(_ranged(gone, "id"), f"{at}/gone")
        made["gone"] = gone.sparkSession.read.parquet(f"{at}/gone").count()
    if texts is not None:
        _write(texts.repartition("part").sortWithinPartitions("part", "id"), f"{at}/texts", "part")
        written = texts.sparkSession.read.schema(texts.schema).parquet(f"{at}/texts")
        r = written.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("t")).first()
        made |= {"rows": r["n"], "tokens": r["t"]}
        if r["n"]:
            _write(_ranged(postings(written) if callable(postings) else postings, "term", "id"), f"{at}/postings")
            _write(_ranged(grams(written) if callable(grams) else grams, "gram", "first"), f"{at}/grams")
    return made


def apply(snapshot: Snapshot, rows: DataFrame | None = None, deletes: DataFrame | None = None) -> Snapshot:
    """The next version, with ``rows`` (``id`` and the fields) inserted or put in the place of rows of the same id, and the ids of ``deletes`` taken out.

    An id that is in both is inserted anew. Of rows that repeat an id in one batch the greatest by its fields stays; null ids
    are left out; ids to delete that are not there do no harm. Cost follows the batch: of the index, only the lengths of the
    rows in the batch's ``part`` folders are read.
    """
    s, spark, names = snapshot, snapshot.spark, list(snapshot.fields)
    texts = None
    if rows is not None:
        one = rows.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.struct(*[F.col(c).cast("string").alias(c) for c in names]).alias("row"))
        one = one.groupBy("id").agg(F.max("row").alias("row")).select("id", "row.*")
        length = sum((F.coalesce(F.size(tokens(F.col(c))), F.lit(0)) for c in names[1:]), F.coalesce(F.size(tokens(F.col(names[0]))), F.lit(0)))
        texts = one.withColumn("length", length.cast("long")).withColumn("part", _part(s.parts))
    ids = None if deletes is None else deletes.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id")).distinct()
    if rows is not None and s.segments:
        own = texts.select("id")
        ids = own if ids is None else ids.unionByName(own).distinct()
    made = _segment(s.root, texts, lambda t: _postings(t, s.fields), lambda t: _gram_lists(t, s.fields), ids if s.segments else None)
    docs, toks = s.docs + made["rows"], s.tokens + made["tokens"]
    if made["gone"] and (held := s.table("texts")) is not None:
        gone = spark.read.parquet(f"{s.root}/segments/{made['name']}/gone")
        touched = [r["p"] for r in gone.select(_part(s.parts).alias("p")).distinct().collect()]  # at most as many as there are parts
        dead = s.live(held.where(F.col("part").isin(touched)).select("id", "length", "seg")).join(gone, "id", "left_semi")
        r = dead.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("t")).first()
        docs, toks = docs - r["n"], toks - r["t"]
    return _commit(spark, s.root, s.version + 1, s.fields, s.parts, [*s.segments, made], docs, toks)


def _tier(segment: dict) -> int:
    return int(math.log(max(1, segment["rows"] + segment["gone"]), FANIN))


def due(segments: tuple[dict, ...], fanin: int = FANIN) -> tuple[int, int] | None:
    """The run of neighbouring segments to merge next, the smallest tier first: it holds at least ``fanin`` of a tier, and none larger."""
    for tier in sorted({_tier(s) for s in segments}):
        start, like = 0, 0
        for i in range(len(segments) + 1):
            if i < len(segments) and _tier(segments[i]) <= tier:
                like += _tier(segments[i]) == tier
                continue
            if like >= fanin:
                return start, i
            start, like = i + 1, 0
    return None


def merge(snapshot: Snapshot, fanin: int = FANIN) -> Snapshot:
    """The same rows in fewer segments: merges runs until none is due. Nothing is tokenised again."""
    s = snapshot
    while (run := due(s.segments, fanin)) is not None:
        a, b = run
        part = Snapshot(s.spark, s.root, s.version, s.fields, s.parts, s.segments[a:b], s.docs, s.tokens)
        texts, gone = part.table("texts"), part.table("gone") if a else None
        kept = {k: part.live(gram_rows(t) if k == "grams" else t).drop("seg") for k in ("texts", "postings", "grams") if (t := part.table(k)) is not None}
        kept |= {"grams": _listed(kept["grams"])} if "grams" in kept else {}
        made = _segment(s.root, kept.get("texts") if texts is not None else None, kept.get("postings"), kept.get("grams"), gone.select("id").distinct() if gone is not None else None)
        s = _commit(s.spark, s.root, s.version + 1, s.fields, s.parts, [*s.segments[:a], made, *s.segments[b:]], s.docs, s.tokens)
    return s


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete all but the last ``keep`` versions and the segments that only they have used. Returns how many segments went."""
    known = versions(spark, root)
    used = {g["name"] for v in known[-keep:] for g in open_index(spark, root, v).segments}
    for v in known[:-keep]:
        files.delete(spark, f"{root}/manifests/{v:012d}.json")
    gone = [n for n in files.names(spark, f"{root}/segments") if n not in used]
    for n in gone:
        files.delete(spark, f"{root}/segments/{n}")
    return len(gone)


def index_of(df: DataFrame, rows: DataFrame, name: str, fields: dict[str, float], parts: int = PARTS) -> Snapshot:
    """The index ``name`` of ``rows`` (``id`` and ``fields``, made from the table ``df``), built once for a state of the table's files.

    It lies in the shared folder under a name made of the files' names, lengths and times, so a rewritten table gets a new one
    and any application finds one that is there. A table that is not read from files gets an index of its own every time.
    """
    spark, mark = df.sparkSession, files.snapshot_mark(df)
    own = uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([name, mark, fields, parts, LAYOUT])).hex if mark else uuid.uuid4().hex
    root = f"{shared_dir(spark)}/loam-index-{own}"
    known = versions(spark, root)
    if 1 not in known:
        began = time.perf_counter()
        with contextlib.suppress(FileExistsError):  # another application has built it meanwhile
            apply(open_index(spark, root, 0) if known else create(spark, root, fields, parts), rows)
        BUILDS.append((name, time.perf_counter() - began))
    return open_index(spark, root, 1)
