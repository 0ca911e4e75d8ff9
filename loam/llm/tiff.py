"""TIFF: a writer for byte payloads and a reader that walks image directories and gives one row per page.

The reader handles both byte orders and fill orders, strips and tiles, chunky and planar samples of 8 or 16 bits, no
compression, PackBits, LZW and deflate, and horizontal differencing. A file that is broken, or asks for more than
``MOST_BYTES`` a page, ends in an error of its own and harms no other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, small_batches, texts_of, tidy

#: Fixed values of the format: tags, field widths, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 322, 323, 324, 325
FILL_ORDER, PLANAR = 266, 284
FIELD = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4)}
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
LINE = 64
ROWS_PER_STRIP = 512
#: A page of more unpacked bytes is refused.
MOST_BYTES = 1 << 30
#: How the pages of a text are stored, in turn: compression, predictor, tile (0: strips).
PAGES = ((DEFLATE, 2, 0), (PACKBITS, 1, 16), (LZW, 1, 0), (DEFLATE, 1, 32))
#: Bytes with their bits in reverse, for files whose fill order is 2.
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more bytes, in packets of at most 128; all else as literal packets."""
    out = bytearray()

    def literal(a: int, b: int) -> None:
        for lo in range(a, b, 128):
            part = data[lo : min(b, lo + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    x = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    lens = np.diff(np.append(starts, len(x)))
    at = 0
    for a, n in zip(starts[lens >= 3].tolist(), lens[lens >= 3].tolist(), strict=True):
        literal(at, a)
        at = a + n
        while n > 1:
            run = min(n, 128)
            out += bytes([257 - run, data[a]])
            n -= run
        literal(at - n, at)
    literal(at, len(data))
    return bytes(out)


def packbits_decode(data: bytes, most: int = MOST_BYTES) -> bytes:
    """At least the first ``most`` bytes, or all if there are fewer."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widths grown one code early as the format asks."""
    codes, widths = [256], [9]
    table: dict[int, int] = {}  # code before << 8 | byte -> code
    free, width, last = 258, 9, -1
    for b in data:
        if last < 0:
            last = b
            continue
        key = last << 8 | b
        if (found := table.get(key)) is not None:
            last = found
            continue
        codes.append(last)
        widths.append(width)
        table[key] = free
        free += 1
        last = b
        if free >= 4094:
            codes.append(256)
            widths.append(width)
            table, free, width = {}, 258, 9
        elif free >= 1 << width:
            width += 1
    if last >= 0:
        codes.append(last)
        widths.append(width)
        if free + 1 >= 1 << width and width < 12:
            width += 1
    codes.append(257)
    widths.append(width)
    # Each code's bits, then all of them end to end.
    code, wide = np.array(codes, np.uint16), np.array(widths, np.uint16)
    bits = np.unpackbits((code << (16 - wide)).astype(">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) < wide[:, None]]).tobytes()


def lzw_decode(data: bytes, most: int = MOST_BYTES) -> bytes:
    """At least the first ``most`` bytes, or all if there are fewer. A code that no entry has been made for is an error."""
    out: list[bytes] = []
    pos, held, bits, size = 0, 0, 0, 0
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table: list[bytes] = list(first)
    width, last = 9, None
    n = len(data)
    while True:
        while bits < width:
            if pos >= n:
                return b"".join(out)
            held = held << 8 | data[pos]
            pos += 1
            bits += 8
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, last = list(first), 9, None
            continue
        known = len(table)
        if last is None:
            if code > 255:
                raise ValueError(f"code {code} at the start of a table")
            got = table[code]
        else:
            if code < known:
                got = table[code]
            elif code == known:
                got = last + last[:1]
            else:
                raise ValueError(f"code {code} where the table ends at {known - 1}")
            table.append(last + got[:1])
            known += 1
        out.append(got)
        last = got
        size += len(got)
        if size >= most:
            return b"".join(out)
        if known + 1 >= 1 << width and width < 12:
            width += 1


_PACK = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1)}


def inflate(data: bytes, most: int) -> bytes:
    """The first ``most`` bytes, or all if there are fewer; a stream that ends too early gives what it holds."""
    return zlib.decompressobj().decompress(data, most)


#: By compression: what unpacks a part of which so many bytes are wanted. None makes much more than that.
_UNPACK = {NONE: lambda data, most: data, PACKBITS: packbits_decode, LZW: lzw_decode, DEFLATE: inflate, DEFLATE_OLD: inflate}


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    data: bytes


def write(pages: list[np.ndarray], how: list[tuple[int, int, int]], order: str = "<", rows_per_strip: int = ROWS_PER_STRIP) -> bytes:
    """A file of grey (rows x columns) or chunky (rows x columns x samples) pages of uint8 or uint16.

    ``how`` has each page's compression, predictor and tile: strips if 0, else tiles of ``tile`` x ``tile``.
    """
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page, (compression, predictor, tile) in zip(pages, how, strict=True):
        image = page[:, :, None] if page.ndim == 2 else page
        rows, cols, samples = image.shape
        if tile:
            parts = []
            for y in range(0, rows, tile):
                for x in range(0, cols, tile):
                    full = np.zeros((tile, tile, samples), image.dtype)
                    cut = image[y : y + tile, x : x + tile]
                    full[: cut.shape[0], : cut.shape[1]] = cut
                    parts.append(full)
        else:
            parts = [image[y : y + rows_per_strip] for y in range(0, rows, rows_per_strip)]
        at, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            raw = _PACK[compression](part.astype(part.dtype.newbyteorder(order)).tobytes())
            at.append(len(out))
            sizes.append(len(raw))
            out += raw
        if len(out) % 2:
            out.append(0)
        bits = image.dtype.itemsize * 8
        tags = [(WIDTH, 4, [cols]), (HEIGHT, 4, [rows]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1 if samples == 1 else 2]), (SAMPLES, 3, [samples])]
        tags += [(PREDICTOR, 3, [predictor])] if predictor != 1 else []
        tags += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_AT, 4, at), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_AT, 4, at), (STRIP_ROWS, 4, [rows_per_strip]), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(tags):
            code, wide = FIELD[kind]
            raw = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(raw) > 4:
                where = struct.pack(order + "I", len(out))
                out += raw + b"\0" * (len(raw) % 2)
            else:
                where = raw.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + where
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read(data: bytes) -> Iterator[Page]:
    """Pages in the order of the directories. Broken files raise ``ValueError``."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen, number = set(), 0
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("broken directory chain")
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + "H", data, at)
            yield _page(data, _tags(data, at, n, order), order, number)
            (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        except (struct.error, KeyError, IndexError, TypeError, OverflowError, ZeroDivisionError, MemoryError, zlib.error) as e:
            raise ValueError(f"page {number}: {type(e).__name__} {e}") from e
        number += 1


def _tags(data: bytes, at: int, n: int, order: str) -> dict[int, tuple[int, ...]]:
    tags: dict[int, tuple[int, ...]] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in FIELD and kind != 2:
            code, wide = FIELD[kind]
            where = at + 10 + 12 * i
            if count * wide > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            if where + count * wide > len(data):
                raise ValueError(f"values of tag {tag} lie outside the file")
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
    return tags


def _page(data: bytes, tags: dict[int, tuple[int, ...]], order: str, number: int) -> Page:
    one = lambda tag, default: (tags.get(tag) or (default,))[0]
    cols, rows, samples, bits, packed = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 8), one(COMPRESSION, NONE)
    if packed not in _UNPACK or any(b not in (8, 16) or b != bits for b in tags.get(BITS, (8,))):
        raise ValueError(f"page {number}: compression {packed} with samples of {tags.get(BITS)} bits")
    if one(PREDICTOR, 1) not in (1, 2) or one(FILL_ORDER, 1) not in (1, 2) or one(PLANAR, 1) not in (1, 2):
        raise ValueError(f"page {number}: unknown predictor, fill order or planes")
    tiled = TILE_AT in tags
    wide = one(TILE_WIDTH, 0) if tiled else cols
    high = one(TILE_HEIGHT, 0) if tiled else min(one(STRIP_ROWS, rows), rows)
    if min(cols, rows, samples, wide, high) < 1:
        raise ValueError(f"page {number}: a side of no length")
    planes = samples if one(PLANAR, 1) == 2 else 1
    together = samples // planes
    across, down = -(-cols // wide), -(-rows // high)
    if max(rows * cols * samples, wide * high * together) * bits // 8 > MOST_BYTES:
        raise ValueError(f"page {number}: larger than {MOST_BYTES} bytes")
    parts = list(zip(tags[TILE_AT if tiled else STRIP_AT], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True))
    if len(parts) != across * down * planes:
        raise ValueError(f"page {number}: {len(parts)} parts where {across * down * planes} belong")
    kind = np.dtype(f"{order}u{bits // 8}")
    image = np.zeros((rows, cols, samples), kind.newbyteorder("="))
    for i, (at, size) in enumerate(parts):
        plane, place = divmod(i, across * down)
        y, x = place // across * high, place % across * wide
        tall = high if tiled else min(high, rows - y)
        raw = data[at : at + size]
        wanted = tall * wide * together * bits // 8
        try:
            raw = _UNPACK[packed](raw.translate(_REVERSED) if one(FILL_ORDER, 1) == 2 else raw, wanted)
        except ValueError as e:
            raise ValueError(f"page {number}: part {i}: {e}") from e
        if len(raw) < wanted:
            raise ValueError(f"page {number}: part {i} is too short")
        part = np.frombuffer(raw, kind, tall * wide * together).reshape(tall, wide, together)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=image.dtype)
        image[y : y + tall, x : x + wide, plane * together : (plane + 1) * together] = part[: rows - y, : cols - x]
    return Page(number, cols, rows, samples, bits, packed, image.tobytes())


def read_pages(df: DataFrame, id_col: str, file_col: str) -> DataFrame:
    """One row per page of each file: ``id, page, width, height, samples, bits, compression, data, error``.

    Null files give no row, repeated rows their pages each; a broken file gives one row with null columns and its error,
    after the pages before it; an empty table gives none; other columns play no part, whatever their names.
    """
    bound_batches(df.sparkSession)
    schema = "id long, page int, width int, height int, samples int, bits int, compression int, data binary, error string"
    kinds = [pa.int64(), *[pa.int32()] * 6, pa.binary(), pa.string()]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in _rows(key, file):  # a page a batch: it may be large
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return df.select(df[id_col].cast("long").alias("id"), df[file_col].alias("file")).mapInArrow(run, schema)


def _rows(key: int | None, file: bytes | None) -> Iterator[tuple]:
    if file is None:
        return
    try:
        for p in read(file):
            yield key, p.number, p.width, p.height, p.samples, p.bits, p.compression, p.data, None
    except ValueError as e:
        yield key, None, None, None, None, None, None, None, str(e)


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + b"\0" * (LINE - len(raw) % LINE if len(raw) % LINE or not raw else 0)


def store(payload: bytes) -> bytes:
    """The file of a payload of whole lines: up to ``len(PAGES)`` grey pages of ``LINE`` columns, each stored in its own way."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    each = -(-len(lines) // len(PAGES))
    pages = [lines[at : at + each] for at in range(0, len(lines), each)]
    return write(pages, [PAGES[i] for i in range(len(pages))])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_file: bool = False) -> DataFrame:
    """Store every whole text as a file of grey pages of 64 columns, walk its directories, read the pages back and describe them.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature`` (and ``file`` if
    asked), one row per input row. Null and empty texts are one line of zeros; a text's lines are dealt out in order over
    up to four pages, which differ in compression, predictor and tiles. The feature names the number of pages, their
    compressions, the mean of the samples and their entropy in bits, from the samples read back. Texts of any length are
    stored whole; repeated rows and rows with a null id are returned each; an empty table gives none; other columns play
    no part, whatever their names.
    """
    bound_batches(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", file binary" * keep_file

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                n, raw = payload_of(text)
                file = store(raw)
                pages = list(read(file))
                back = b"".join(p.data for p in pages)
                counts = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
                share = counts[counts > 0] / len(back)
                how = "+".join(str(p.compression) for p in pages)
                feature = f"{len(pages)} pages {how} mean={counts @ np.arange(256) / len(back):.4f} entropy={abs(float(-(share * np.log2(share)).sum())):.4f}"
                rows.append((key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-LINE:]), len(file), hashlib.sha256(file).hexdigest(), feature, file if keep_file else None))
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[8], pa.binary())] * keep_file, names=names + ["file"] * keep_file)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
