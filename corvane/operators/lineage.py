"""Cutting lineage between the rounds of an iteration."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a folder of our own serves a session of one machine; on a cluster that is an error.
    """
    context = spark.sparkContext._jsc.sc()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and context.getCheckpointDir().isDefined():
        where = context.getCheckpointDir().get()
    if not where and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir names no folder; on a cluster it must be one that all hosts share")
    where = where or tempfile.mkdtemp(prefix="corvane-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/corvane-{kind}-{uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours, wherever it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept where every executor can read it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes below which an input may lie in fewer pieces than there are cores.
SMALL = 64 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores when the input is small; a larger one is left as its files divide it.

    A file of one row group is one task however many cores wait, which matters where each row costs much. Filters and
    column choices still reach the scan.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if _estimate(rows) < SMALL and len(rows.inputFiles()) < cores else rows


def _estimate(rows: DataFrame) -> float:
    """The planner's size in bytes; after several joins that number can be too long for Python to read."""
    try:
        return float(int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    except (ValueError, OverflowError):
        return float("inf")
