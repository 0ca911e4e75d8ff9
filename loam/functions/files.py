"""Small files and listings through Spark's own file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    fs, p = _at(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def length(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below a folder; 0 if it does not exist."""
    fs, p = _at(spark, folder)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file under a passing name, then rename it; an error if the name is taken already."""
    fs, p = _at(spark, path)
    _, part = _at(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(p) or not fs.rename(part, p):
        fs.delete(part, False)
        raise FileExistsError(path)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a folder, unless the other name is taken."""
    fs, p = _at(spark, path)
    _, q = _at(spark, to)
    return not fs.exists(q) and fs.rename(p, q)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def snapshot_mark(df: DataFrame) -> str:
    """Digest of the files that a table is read from: names, lengths and times of change. A rewritten table has another one.

    Folders are listed once each, whatever the number of their files. Empty for a table that is not read from files.
    """
    spark, files = df.sparkSession, set(df.inputFiles())
    if not files:
        return ""
    found = []
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        fs, p = _at(spark, folder)
        found += [f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}" for s in fs.listStatus(p) if s.isFile()]
    return hashlib.sha256("\n".join(sorted(files) + sorted(found)).encode()).hexdigest()
