"""Symbol indexes in their protocol-buffer form: files to documents with ``readers.INDEX_SCHEMA``, and back.

A batch's messages of one kind are read side by side, the next field of each at a time, and written column by column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from loam.sources.readers import INDEX_SCHEMA

#: Field numbers of the format.
DOCUMENTS = 2
PATH, OCCURRENCES, SYMBOLS, LANGUAGE = 1, 2, 3, 4
RANGE, SYMBOL, ROLES, ENCLOSING = 1, 2, 3, 7
NAME, DOCS, RELATIONSHIPS, KIND, DISPLAY = 1, 3, 4, 5, 6
RELATED, REFERENCE, IMPLEMENTATION = 1, 2, 3
#: Documents, and their bytes, of a batch of rows.
BATCH, BYTES = 4096, 4 << 20
#: Of so few messages the rest is read one by one.
ALONE = 8


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("broken number")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _next(data: memoryview, at: int) -> tuple[int, int, int, int, int]:
    """Number, kind, value, start and end of the field at a place; the end is also the next field's place."""
    key, at = _varint(data, at)
    number, kind = key >> 3, key & 7
    value, start = 0, at
    if kind == 0:
        value, at = _varint(data, at)
    elif kind == 2:
        size, start = _varint(data, at)
        at = start + size
    elif kind in (1, 5):
        at += 8 if kind == 1 else 4
    else:
        raise ValueError(f"field {number} of kind {kind}")
    if at > len(data):
        raise ValueError("a field is longer than its message")
    return number, kind, value, start, at


def _varints(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number at each place, and the place after it."""
    value, at, open_ = np.zeros(len(at), np.uint64), at.copy(), np.arange(len(at))
    for shift in range(0, 70, 7):
        if (at[open_] >= end[open_]).any():
            raise ValueError("broken number")
        b = data[at[open_]].astype(np.uint64)
        value[open_] |= (b & np.uint64(127)) << np.uint64(shift)
        at[open_] += 1
        open_ = open_[b > 127]
        if not len(open_):
            return value, at
    raise ValueError("broken number")


class _Fields:
    """All fields of messages that lie at ``start`` to ``end`` of ``data``, in order: ``of`` is the message's place."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.messages = data, len(start)
        open_, at, found = np.flatnonzero(start < end), start.astype(np.int64), []
        while len(open_) > ALONE:
            key, here = _varints(data, at[open_], end[open_])
            number, kind = (key >> np.uint64(3)).astype(np.int64), (key & np.uint64(7)).astype(np.int64)
            if (wrong := ~np.isin(kind, (0, 1, 2, 5))).any():
                raise ValueError(f"field {number[wrong][0]} of kind {kind[wrong][0]}")
            value, first, after = np.zeros(len(open_), np.uint64), here.copy(), here.copy()
            for k in (0, 2):
                if (m := kind == k).any():
                    value[m], after[m] = _varints(data, here[m], end[open_][m])
            m = kind == 2
            if (value[m] > np.uint64(len(data))).any():
                raise ValueError("a field is longer than its message")
            first[m] = after[m]
            after[m] += value[m].astype(np.int64)
            after += np.where(kind == 1, 8, 0) + np.where(kind == 5, 4, 0)
            if (after > end[open_]).any():
                raise ValueError("a field is longer than its message")
            found.append((open_, number, kind, value, first, after))
            at[open_] = after
            open_ = open_[after < end[open_]]
        alone, view = [], memoryview(data)
        for i in open_.tolist():
            place, stop = int(at[i]), int(end[i])
            own = view[:stop]
            while place < stop:
                number, kind, v, first, place = _next(own, place)
                alone.append((i, number, kind, v, first, place))
        if alone:
            found.append(tuple(np.array(c, np.uint64 if k == 3 else np.int64) for k, c in enumerate(zip(*alone, strict=True))))
        if not found:
            found = [tuple(np.zeros(0, np.uint64 if k == 3 else np.int64) for k in range(6))]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        self.of, self.number, self.kind, self.value, self.start, self.end = (c[order] for c in columns)

    def _last(self, number: int, kind: int) -> np.ndarray:
        """The place of each message's last field of a number, or -1."""
        last, m = np.full(self.messages, -1), np.flatnonzero((self.number == number) & (self.kind == kind))
        last[self.of[m]] = m  # of places that repeat the last one stays
        return last

    def number_of(self, number: int) -> np.ndarray:
        last = self._last(number, 0)
        return np.where(last >= 0, _int32(self.value[last] if len(self.value) else np.zeros(len(last), np.uint64)), 0).astype(np.int32)

    def text_of(self, number: int) -> pa.Array:
        last = self._last(number, 2)
        if not len(self.start):
            return _texts(self.data, np.zeros(len(last), np.int64), np.zeros(len(last), np.int64))
        return _texts(self.data, np.where(last >= 0, self.start[last], 0), np.where(last >= 0, self.end[last], 0))

    def each(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of all fields of a number, and offsets of them by message."""
        m = (self.number == number) & (self.kind == 2)
        return self.start[m], self.end[m], _offsets(np.bincount(self.of[m], minlength=self.messages))

    def messages_of(self, number: int) -> tuple[_Fields, np.ndarray]:
        start, end, offsets = self.each(number)
        return _Fields(self.data, start, end), offsets

    def numbers_of(self, number: int, nullable: bool = False) -> pa.Array:
        """Lists of 32-bit numbers, packed or one by one."""
        m = np.flatnonzero((self.number == number) & np.isin(self.kind, (0, 2)))
        packed = m[self.kind[m] == 2]
        single = m[self.kind[m] == 0]
        fields, values = [single], [self.value[single]]
        rest, at = packed[self.start[packed] < self.end[packed]], self.start.copy()
        while len(rest) > ALONE:
            v, at[rest] = _varints(self.data, at[rest], self.end[rest])
            fields.append(rest)
            values.append(v)
            rest = rest[at[rest] < self.end[rest]]
        view = memoryview(self.data)
        for i in rest.tolist():
            place, stop, found = int(at[i]), int(self.end[i]), []
            own = view[:stop]
            while place < stop:
                v, place = _varint(own, place)
                found.append(v & 0xFFFFFFFFFFFFFFFF)
            fields.append(np.full(len(found), i))
            values.append(np.array(found, np.uint64))
        field, value = np.concatenate(fields), np.concatenate(values)
        order = np.argsort(field, kind="stable")
        counts = np.bincount(self.of[field], minlength=self.messages)
        there = np.zeros(self.messages, bool)
        there[self.of[m]] = True
        return _list(_offsets(counts), pa.array(_int32(value[order]), pa.int32()), None if not nullable else ~there)


def _int32(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int32)


def _list(offsets: np.ndarray, values: pa.Array, nulls: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=None if nulls is None else pa.array(nulls))


def _slices(data: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of slices, one after another."""
    ends = np.cumsum(sizes)
    return data[np.repeat(start - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    body, offsets = _slices(data, start, end - start), _offsets(end - start)
    raw = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:  # not UTF-8
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def _documents(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    struct = lambda **columns: pa.StructArray.from_arrays(list(columns.values()), list(columns))
    d = _Fields(data, start, end)
    o, o_at = d.messages_of(OCCURRENCES)
    occurrences = struct(range=o.numbers_of(RANGE), symbol=o.text_of(SYMBOL), roles=pa.array(o.number_of(ROLES)), enclosing=o.numbers_of(ENCLOSING, True))
    s, s_at = d.messages_of(SYMBOLS)
    r, r_at = s.messages_of(RELATIONSHIPS)
    related = struct(symbol=r.text_of(RELATED), reference=pa.array(r.number_of(REFERENCE) != 0), implementation=pa.array(r.number_of(IMPLEMENTATION) != 0))
    first, last, docs_at = s.each(DOCS)
    symbols = struct(symbol=s.text_of(NAME), name=s.text_of(DISPLAY), kind=pa.array(s.number_of(KIND)), docs=_list(docs_at, _texts(data, first, last)), relationships=_list(r_at, related))
    return [d.text_of(PATH), d.text_of(LANGUAGE), _list(o_at, occurrences), _list(s_at, symbols)]


def decode(files: DataFrame) -> DataFrame:
    """Documents of index files (column ``content``), some thousand rows at a time. Null contents have none; a broken file stops the query."""
    kind = to_arrow_type(StructType.fromDDL(INDEX_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                if not content.is_valid:
                    continue
                raw = content.as_py()
                view, at, starts, ends = memoryview(raw), 0, [], []
                while at < len(raw):
                    number, wire, _, start, at = _next(view, at)
                    if number == DOCUMENTS and wire == 2:
                        starts.append(start)
                        ends.append(at)
                    if starts and (at == len(raw) or len(starts) == BATCH or at - starts[0] > BYTES):
                        own = np.frombuffer(view[starts[0] : at], np.uint8)
                        columns = _documents(own, np.array(starts) - starts[0], np.array(ends) - starts[0])
                        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kind, strict=True)], names=[f.name for f in kind])
                        starts, ends = [], []

    return files.select("content").mapInArrow(run, INDEX_SCHEMA)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the index files below ``path``, through Spark's reader of binary files."""
    return decode(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


#: A column of byte strings: their sizes, and the bytes one after another.
Parts = tuple[np.ndarray, np.ndarray]


def _packed(numbers: np.ndarray) -> Parts:
    v = numbers.astype(np.int64).view(np.uint64)
    sizes = np.ones(len(v), np.int64)
    for k in range(7, 70, 7):
        sizes += v >= np.uint64(1 << k) if k < 64 else 0
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        m = sizes > k
        out[starts[m] + k] = ((v[m] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(sizes[m] > k + 1, 128, 0).astype(np.uint8)
    return sizes, out


def _joined(*parts: Parts) -> Parts:
    """Row by row, one part after another."""
    sizes = sum(p[0] for p in parts)
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for own, body in parts:
        out[np.repeat(at - (np.cumsum(own) - own), own) + np.arange(len(body))] = body
        at = at + own
    return sizes, out


def _sized(number: int, part: Parts) -> Parts:
    n = len(part[0])
    return _joined((np.ones(n, np.int64), np.full(n, number << 3 | 2, np.uint8)), _packed(part[0]), part)


def _number(number: int, values: pa.Array) -> Parts:
    """Nothing where the value is 0 or null."""
    v = np.asarray(values.cast(pa.int64()).fill_null(0))
    return _where(v != 0, _joined((np.ones(len(v), np.int64), np.full(len(v), number << 3, np.uint8)), _packed(v)))


def _where(kept: np.ndarray, part: Parts) -> Parts:
    return np.where(kept, part[0], 0), part[1][np.repeat(kept, part[0])]


def _text(values: pa.Array) -> Parts:
    whole = pa.concat_arrays([values.fill_null("")])
    at = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64) if len(whole) else np.zeros(1, np.int64)
    body = np.frombuffer(whole.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return np.diff(at), body


def _counts(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.list_value_length(lists).fill_null(0)).astype(np.int64)


def _grouped(counts: np.ndarray, part: Parts) -> Parts:
    """Neighbouring byte strings put together, so many to a row."""
    ends = np.concatenate(([0], np.cumsum(part[0])))
    at = np.concatenate(([0], np.cumsum(counts)))
    return np.diff(ends[at]), part[1]


def _line(lists: pa.Array) -> Parts:
    return _grouped(_counts(lists), _packed(np.asarray(lists.flatten().cast(pa.int64()))))


def _encoded(batch: pa.RecordBatch) -> bytes:
    path, language, occurrences, symbols = batch.columns
    range_, symbol, roles, enclosing = occurrences.flatten().flatten()
    there = np.asarray(enclosing.is_valid())
    o = _joined(_sized(RANGE, _line(range_)), _sized(SYMBOL, _text(symbol)), _number(ROLES, roles), _where(there, _sized(ENCLOSING, _line(enclosing))))
    name, display, kind, docs, relationships = symbols.flatten().flatten()
    related, reference, implementation = relationships.flatten().flatten()
    r = _joined(_sized(RELATED, _text(related)), _number(REFERENCE, reference), _number(IMPLEMENTATION, implementation))
    lists = [_grouped(_counts(docs), _sized(DOCS, _text(docs.flatten()))), _grouped(_counts(relationships), _sized(RELATIONSHIPS, r))]
    s = _joined(_sized(NAME, _text(name)), *lists, _number(KIND, kind), _sized(DISPLAY, _text(display)))
    d = [_grouped(_counts(occurrences), _sized(OCCURRENCES, o)), _grouped(_counts(symbols), _sized(SYMBOLS, s))]
    return _sized(DOCUMENTS, _joined(_sized(PATH, _text(path)), *d, _sized(LANGUAGE, _text(language))))[1].tobytes()


def encode(documents: DataFrame) -> DataFrame:
    """Index files (column ``content``) of documents, a batch of rows a file."""
    names = [x.name for x in StructType.fromDDL(INDEX_SCHEMA)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([_encoded(batch)], pa.binary())], names=["content"])

    return documents.select(*[F.col(n) for n in names]).mapInArrow(run, "content binary")
