"""Feeds of JSON lines, and running a stream over what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import fresh_dir

RECORD = "type string, signal string, state string, text string, seq long, at timestamp, host_pid long, host_started_at_unix_ms long, version string, operation string, operation_filesystem string, operation_total long, operation_done long, registry_total long, registry_complete long, settled boolean"


def parsed(lines: DataFrame, schema: str = RECORD, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of lines. A line that is no JSON object is ignored; an object with unknown or absent fields is a record."""
    object_ = F.trim(line).rlike(r"^\{[\s\S]*\}$")
    record = F.from_json(line, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.filter(object_).select(*keep, record.alias("r")).filter("r is not null and r._broken is null")
    return rows.select(*keep, *(f"r.{f.split()[0]}" for f in schema.split(", ")))


def since(records: DataFrame, sequence: str, after: Column) -> DataFrame:
    """What came after a point; replaying from an earlier one closes the gap between a look and an attach."""
    return records.filter(F.col(sequence) > after)


def available(rows: DataFrame, mode: str = "append", checkpoint: str | None = None, path: str | None = None, timeout_s: int = 600) -> DataFrame:
    """A streaming DataFrame run over all that is there now, as the rows it wrote; it resumes from a checkpoint.

    Append only: the sink is Parquet, whose commit log leaves out what failed tasks wrote.
    """
    spark = rows.sparkSession
    path = path or fresh_dir(spark, "stream")
    query = rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint or fresh_dir(spark, "progress")).trigger(availableNow=True).start()
    if not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream took more than {timeout_s} s")
    return spark.read.schema(rows.schema).parquet(path)


def each_batch(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append", timeout_s: int = 600) -> None:
    spark = rows.sparkSession
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or fresh_dir(spark, "progress")).foreachBatch(write).trigger(availableNow=True).start()
    if not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream took more than {timeout_s} s")


class Upserts:
    """A table of the latest row of each key, written batch by batch as versions; a batch that is run again changes nothing."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], order: str):
        self.spark, self.root, self.key, self.order, self.last = spark, root, key, order, -1

    def write(self, batch: DataFrame, number: int) -> None:
        rows = batch if self.last < 0 else batch.unionByName(self.read())
        struct = F.max(F.struct(F.col(self.order), *(c for c in rows.columns if c not in (*self.key, self.order)))).alias("x")
        latest = rows.groupBy(*self.key).agg(struct).select(*self.key, "x.*").select(*rows.columns)
        latest.write.mode("overwrite").parquet(f"{self.root}/v={number}")
        self.last = number

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={self.last}")


def as_lines(rows: DataFrame) -> str:
    """rows as files of JSON lines in the shared folder: a feed to read as a stream."""
    at = fresh_dir(rows.sparkSession, "feed")
    rows.select(F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value")).write.text(at)
    return at


def stream_of(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return parsed(lines, schema)
