"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from loam.functions import files

#: Bytes of stored tables for each partition that a shuffle is dealt to at first.
SHUFFLE_BYTES = 4 << 20
_FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a session of one process gets a temporary folder of its own; a cluster is refused, as such a folder would be seen by one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loam-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files, which outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def size_shuffles(spark: SparkSession, folder: str) -> None:
    """Deal shuffles out by the size of the tables in ``folder``, so that a task's memory does not grow with them.

    Adaptive execution joins small partitions again, but never cuts those of a grouping. The session's own number stays where it is
    larger, and where it is enough nothing is set.
    """
    wanted = files.length(spark, folder) // SHUFFLE_BYTES
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(_FIRST, wanted)
    else:
        spark.conf.unset(_FIRST)


def dealt_to(spark: SparkSession) -> int:
    """Partitions that a shuffle is dealt to at first."""
    return int(spark.conf.get(_FIRST, None) or spark.conf.get("spark.sql.shuffle.partitions"))
