"""Jobs, deliveries and remote members: work that leaves the engine, as tables of attempts and results."""

from __future__ import annotations

import hashlib
import hmac
import json
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.operators.service import next_run


def due(schedules: DataFrame, now: Column) -> DataFrame:
    """Schedules (``id, expression, last``) whose next run after ``last`` is not after ``now``, with that time; broken expressions are never due."""
    return next_run(schedules, "last").where(F.col("next") <= now)


def assigned(jobs: DataFrame, workers: int) -> DataFrame:
    """``id, worker``: jobs dealt out over workers by a hash of the id, so that a job that is read again goes to the same one."""
    return jobs.select("id", F.pmod(F.xxhash64("id"), F.lit(workers)).cast("int").alias("worker"))


def handled(jobs: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``id, kind, status, result``: every job (``id, kind, scope``) by the handler of its kind, which maps a table of jobs to ``id, result``.

    A job without a handler, or for which its handler gives no result, has failed.
    """
    none = jobs.where("false").select("id", F.lit("").alias("result"))
    done = reduce(DataFrame.unionByName, [f(jobs.where(F.col("kind") == k)).select("id", F.col("result").cast("string").alias("result")) for k, f in sorted(handlers.items())], none)
    out = jobs.join(done.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left")
    return out.select("id", "kind", F.when(F.col("result").isNotNull(), "completed").otherwise("failed").alias("status"), "result")


def sign(secret: bytes, body: bytes) -> str:
    """Signature of a body: HMAC with SHA-256, in hexadecimal digits."""
    return hmac.new(secret, body, hashlib.sha256).hexdigest()


def deliver(events: DataFrame, post: Callable[[int, str, str, int], bool], secret: bytes, tries: int = 3, pause: float = 0.0) -> DataFrame:
    """Send events (``id, body``) and tell what became of each: ``id, status, attempts, signature``.

    ``post(id, body, signature, attempt)`` says whether a try worked; an exception is a failed try. After ``tries`` of them,
    ``pause`` seconds doubled each time apart, an event is a dead letter. Sending has effects, so a task that is run again
    sends again: receivers tell repeats by id. Write the result once and read it from there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mark, status, attempt = sign(secret, (body or "").encode()), "dead", 0
                while attempt < tries and status == "dead":
                    if attempt:
                        time.sleep(pause * 2 ** (attempt - 1))
                    attempt += 1
                    try:
                        status = "delivered" if post(key, body or "", mark, attempt) else "dead"
                    except Exception:  # noqa: BLE001  whatever a receiver does is a failed try
                        status = "dead"
                rows.append((key, status, attempt, mark))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.string()), strict=True)], names=["id", "status", "attempts", "signature"])

    return events.select(F.col("id").cast("long").alias("id"), "body").mapInArrow(run, "id long, status string, attempts int, signature string")


def remote_rows(members: DataFrame, get: Callable[[str, str], str], schema: str, tries: int = 3) -> DataFrame:
    """Rows of remote members (``repo, address``): ``repo, row, error``, where ``row`` has ``schema``.

    ``get(address, cursor)`` gives a page as JSON, ``{"rows": [...], "next": cursor or null}``; pages are followed to the end, a page
    is asked for ``tries`` times. A member that fails keeps the rows it gave and adds one with its error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(repo, rows, error=None):
            return pa.RecordBatch.from_arrays([pa.array([repo] * len(rows), pa.string()), pa.array(rows, pa.string()), pa.array([error] * len(rows), pa.string())], names=["repo", "row", "error"])

        for batch in batches:
            for repo, address in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cursor, seen = "", set()
                while cursor is not None and cursor not in seen:
                    seen.add(cursor)
                    page, error = None, ""
                    for _ in range(tries):
                        try:
                            page = json.loads(get(address, cursor))
                            break
                        except Exception as e:  # noqa: BLE001  whatever a member answers with
                            error = f"{type(e).__name__}: {e}"
                    if page is None:
                        yield out(repo, [None], error)
                        break
                    if page["rows"]:
                        yield out(repo, [json.dumps(r) for r in page["rows"]])
                    cursor = page.get("next")

    raw = members.select(F.col("repo").cast("string").alias("repo"), F.col("address").cast("string").alias("address")).mapInArrow(run, "repo string, row string, error string")
    return raw.select("repo", F.from_json("row", schema).alias("row"), "error")


def http_page(address: str, cursor: str, token: str = "", seconds: float = 10.0) -> str:
    """A page over HTTP, for :func:`remote_rows`: the cursor goes as a parameter, a token as a bearer's."""
    from urllib.parse import quote
    from urllib.request import Request, urlopen

    request = Request(address + (f"{'&' if '?' in address else '?'}cursor={quote(cursor)}" if cursor else ""), headers={"Authorization": f"Bearer {token}"} if token else {})  # noqa: S310
    with urlopen(request, timeout=seconds) as answer:  # noqa: S310
        return answer.read().decode()
