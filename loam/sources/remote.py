"""Remote members as a Spark data source: ``spark.read.format("loam-remote").option("addresses", ...).load()``.

Each address is a partition, so members are read in parallel and a lost one is read again. Pages are followed to the end;
a page that fails ``tries`` times fails the task, which Spark tries again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from loam.operators.jobs import http_page


class Member(InputPartition):
    def __init__(self, repo: str, address: str) -> None:
        self.repo, self.address = repo, address


class RemoteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.members = [Member(*pair.split("=", 1)) for pair in options["addresses"].split() if pair]
        self.tries, self.token = int(options.get("tries", "3")), options.get("token", "")

    def partitions(self) -> list[Member]:
        return self.members

    def read(self, partition: Member) -> Iterator[tuple[str, str]]:
        cursor, seen = "", set()
        while cursor is not None and cursor not in seen:
            seen.add(cursor)
            for attempt in range(1, self.tries + 1):
                try:
                    page = json.loads(http_page(partition.address, cursor, self.token))
                    break
                except OSError:
                    if attempt == self.tries:
                        raise
            for row in page["rows"]:
                yield partition.repo, json.dumps(row)
            cursor = page.get("next")


class RemoteSource(DataSource):
    """Options: ``addresses`` (``name=address`` pairs, parted by white space), ``tries``, ``token``. Rows: ``repo, body`` with a JSON row each."""

    @classmethod
    def name(cls) -> str:
        return "loam-remote"

    def schema(self) -> str:
        return "repo string, body string"

    def reader(self, schema: StructType) -> RemoteReader:
        return RemoteReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RemoteSource)
