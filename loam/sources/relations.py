"""The engine's domain relations over the supplied tables.

======================  ==========================  ==================================================
relation                from                        columns
======================  ==========================  ==================================================
commits                 orders                      commit_id, author, ts, message
commit_files            lineitem join orders        commit_id, path, author, ts, additions, deletions
symbols                 part                        symbol_id, name, kind, module, line, score
calls                   events                      service, function, ts, n, k
blame                   lineitem join orders        file, author, ts
edges                   lineitem                    src (supplier), dst (part), n
flow                    lineitem with itself        src, dst (parts of lines that follow in an order), n
snapshots               orders by month and nation  target, date, score
======================  ==========================  ==================================================

Each has the same definition as a SQL common table expression in ``CTE``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.sources import writers

HISTORY_AS_OF = "2001-12-01"
USAGE_AS_OF = "2024-02-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("message"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per changed file of a commit; part of a commit's files may repeat."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").cast("long").alias("deletions"))
    return li.join(commits(spark, sf_dir).select("commit_id", "author", "ts"), "commit_id")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("module"), F.col("p_size").cast("long").alias("line"), F.col("p_retailprice").alias("score"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("service"), F.col("event_type").alias("function"), F.col("ts").cast("timestamp").alias("ts"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return li.join(commits(spark, sf_dir).select("commit_id", "author"), "commit_id").select("file", "author", "ts")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges supplier to part with their counts, in one id space: parts are shifted past the suppliers."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges from each line's part to the parts of the order's next line number, with their counts: a graph with depth."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"))
    after = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("src").alias("dst"))
    return li.join(after, ["l_orderkey", "l_linenumber"]).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def kept(spark: SparkSession, sf_dir: str, relation: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """:func:`edges` or :func:`flow`, laid out once for a state of ``lineitem`` in the order of ``src``: traversals read them at every step."""
    return writers.clustered(read(spark, sf_dir, "lineitem"), relation(spark, sf_dir), f"kept-{relation.__name__}", "src", "dst")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return o.groupBy(F.col("c_nationkey").cast("long").alias("target"), month.alias("date")).agg(F.round(F.sum("o_totalprice") / 1000, 2).alias("score"))


#: The same relations in SQL, to be put behind ``WITH``.
CTE = {
    "commits": "commits AS (SELECT o_orderkey AS commit_id, o_custkey AS author, o_orderdate AS ts, o_orderpriority AS message FROM orders)",
    "commit_files": "commit_files AS (SELECT l_orderkey AS commit_id, l_partkey AS path, o_custkey AS author, o_orderdate AS ts, CAST(l_quantity AS BIGINT) AS additions, CAST(l_linenumber AS BIGINT) AS deletions FROM lineitem JOIN orders ON o_orderkey = l_orderkey)",
    "symbols": "symbols AS (SELECT p_partkey AS symbol_id, p_name AS name, p_type AS kind, p_brand AS module, CAST(p_size AS BIGINT) AS line, p_retailprice AS score FROM part)",
    "calls": "calls AS (SELECT event_id, user_id AS service, event_type AS function, ts, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)",
    "blame": "blame AS (SELECT l_partkey AS file, o_custkey AS author, l_shipdate AS ts FROM lineitem JOIN orders ON o_orderkey = l_orderkey)",
    "edges": "edges AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst, count(*) AS n FROM lineitem GROUP BY 1, 2)",
    "flow": "flow AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS n FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2)",
    "snapshots": "snapshots AS (SELECT CAST(c_nationkey AS BIGINT) AS target, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, round(sum(o_totalprice) / 1000, 2) AS score FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)",
}


def using(*names: str) -> str:
    """``WITH`` and the named relations, for SQL twins."""
    return "WITH " + ", ".join(CTE[n] for n in names) + " "
