"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.shared import shared_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: A word, as the contracts define it, in Java's dialect.
WORD = r"[^\x20\x09-\x0D]+"
#: Paths of stored tables, for :func:`clear_stored`.
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_file(address: str, data: bytes) -> None:
    """Write a whole file into the shared folder: under another name first, then renamed, so that none is ever seen half."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(address) if ":/" in address else (fs.LocalFileSystem(), address)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as compressed Parquet and go on from the files, which outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loam-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


def clear_later(path: str) -> None:
    """Name a folder for :func:`clear_stored`."""
    _WRITTEN.append(path)


def clear_stored(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete what :func:`stored` and :func:`clear_later` have named from number ``since`` on, but for the table ``keep``, once no
    result that reads it is needed. Returns how many."""
    held = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in keep.inputFiles()} if keep is not None else set()
    done, left = 0, []
    while len(_WRITTEN) > since:
        name = _WRITTEN.pop()
        if name.rsplit("/", 1)[-1] in held:
            left.append(name)
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        done += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN.extend(left)
    return done


def written() -> int:
    """How many tables have been named so far, for ``since``."""
    return len(_WRITTEN)


def lower_ascii(text):
    """Lower-case A-Z only. Where all characters are ASCII the faster ``lower`` does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def crc_mod(doc_id, n: int):
    """crc32 of the id as decimal text, modulo ``n``."""
    return F.crc32(doc_id.cast("string")) % F.lit(n)


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows, the same ones on every run: those whose hashed key falls below a fraction of the range."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 20)) < int((1 << 20) * rows / total))


#: Rows of the batches that Spark sends to Python workers; its own default is ten times as many.
ARROW_ROWS = 1000
_ARROW_CONF, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def bound_batches(spark: SparkSession) -> None:
    """Let Spark send batches of ``ARROW_ROWS`` rows to Python workers, so that neither side holds many texts at a time; a session that has set another number keeps it."""
    if spark.conf.get(_ARROW_CONF) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_CONF, ARROW_ROWS)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of ``rows`` rows for what is executed inside."""
    before = spark.conf.get(_ARROW_CONF)
    spark.conf.set(_ARROW_CONF, rows)
    try:
        yield
    finally:
        spark.conf.set(_ARROW_CONF, before)


def tidy(run: Callable) -> Callable:
    """A task's function on batches that gives the memory it has freed back to the system at its end: workers serve one operator after another."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text: bounds the memory of a worker, drops nothing."""
    for batch in batches:
        if not batch.num_rows:
            continue
        each = max(1, int(batch.num_rows * most / max(1, batch.column(batch.schema.get_field_index(text)).nbytes)))
        for at in range(0, batch.num_rows, each):
            yield batch.slice(at, each)
