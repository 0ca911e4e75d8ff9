"""A polled folder as a streaming source: ``spark.readStream.format("loam-poll").option("path", ...).load()``.

A poll lists the folder and compares it with the listing before: files that came, went, or have another length or time of
change. Every poll that finds something is kept as one numbered record of changes in the source's ``log`` folder, under the
number that is the stream's offset. So a batch is a range of records, the same however often it is replayed, after a restart
too, and a change is given out once. Records below the last committed offset are deleted, but for the listing itself.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "poll long, path string, change string, bytes long, modified long"
#: Changes a partition holds at most.
SLICE = 10_000


class Records(InputPartition):
    def __init__(self, log: str, number: int, start: int, end: int) -> None:
        self.log, self.number, self.start, self.end = log, number, start, end


def _store(address: str):
    """The file system of an address and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address) if ":/" in address else (fs.LocalFileSystem(), address)


def listing(folder: str, ignore: list[str]) -> dict[str, list[int]]:
    """Files below a folder by their relative path: length and time of change in nanoseconds. Hidden names and ``ignore`` patterns are left out, files and folders alike."""
    from pyarrow import fs

    store, top = _store(folder)
    found = {}
    for f in store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
        path = f.path[len(top) :].strip("/")
        if f.is_file and not any(n.startswith(".") or any(fnmatch.fnmatch(n, p) for p in ignore) for n in path.split("/")):
            found[path] = [f.size, f.mtime_ns]
    return found


def compared(before: dict[str, list[int]], now: dict[str, list[int]]) -> list[list]:
    """``path, change, bytes, modified`` by path: created, changed or removed."""
    out = []
    for path in sorted(before.keys() | now.keys()):
        old, new = before.get(path), now.get(path)
        if old != new:
            out.append([path, "created" if old is None else "removed" if new is None else "changed", *(new or [None, None])])
    return out


def _load(log: str, name: str):
    store, top = _store(log)
    with store.open_input_stream(f"{top}/{name}") as f:
        return json.loads(f.readall())


class PollReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.log = options["path"], options["log"]
        self.ignore = options.get("ignore", "").split()

    def _write(self, name: str, value) -> None:
        store, top = _store(self.log)
        store.create_dir(top, recursive=True)
        with store.open_output_stream(f"{top}/.{name}.part") as out:
            out.write(json.dumps(value).encode())
        store.move(f"{top}/.{name}.part", f"{top}/{name}")

    def _state(self) -> tuple[int, dict]:
        """Number of the last poll with changes, and the listing that it left."""
        try:
            number, files = _load(self.log, "listing")
        except FileNotFoundError:
            number, files = 0, {}
        return number, files

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        number, files = self._state()
        now = listing(self.folder, self.ignore)
        changes = compared(files, now)
        if changes:
            # The record comes first: if the listing is not written, the next poll finds the same changes and more, under the same number.
            number += 1
            self._write(f"{number}.changes", changes)
            self._write("listing", [number, now])
        return {"poll": number}

    def partitions(self, start: dict, end: dict) -> list[Records]:
        out = []
        for number in range(start["poll"] + 1, end["poll"] + 1):
            n = len(_load(self.log, f"{number}.changes"))
            out += [Records(self.log, number, at, min(at + SLICE, n)) for at in range(0, n, SLICE)]
        return out

    def read(self, partition: Records) -> Iterator[tuple]:
        for row in _load(partition.log, f"{partition.number}.changes")[partition.start : partition.end]:
            yield (partition.number, *row)

    def commit(self, end: dict) -> None:
        from pyarrow import fs

        store, top = _store(self.log)
        for f in store.get_file_info(fs.FileSelector(top)):
            number, _, kind = f.base_name.partition(".")
            if kind == "changes" and int(number) < end["poll"]:  # the last one may be asked for again
                store.delete_file(f.path)


class PollSource(DataSource):
    """Options: ``path`` (a folder), ``log`` (a shared folder for the stream's records, one a stream), ``ignore`` (name patterns, parted by white space)."""

    @classmethod
    def name(cls) -> str:
        return "loam-poll"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> PollReader:
        return PollReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PollSource)
