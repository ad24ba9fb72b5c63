"""A store of immutable Parquet shards with size-tiered compaction and atomically committed, versioned manifests."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, settle

ENTRY = "shard string, path string, tier int, docs long, bytes long"
#: Shards of one run, at most, and runs of one round: what the driver names at once is bounded by their product.
RUN_SHARDS, WAVE = 512, 256
#: Shards, and full files, that one lane of the planner holds on average.
LANE_SHARDS, LANE_FILES = 4096, 64
#: The tier below which all sizes are one.
LEAST_TIER = -6
#: Seconds after which a file that no version has ever named is taken for the remains of a writer that died.
ABANDONED = 24 * 3600
_ONE_AT_A_TIME = threading.Lock()


class Taken(Exception):
    """Another writer has committed the version first."""


@contextmanager
def _separate(spark: SparkSession) -> Iterator[None]:
    """Within it, a union keeps the single partitions of its parts apart; by default it would make one of them."""
    name = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Store:
    """Layout under root: data/<version>-<id>/ holds shards, manifests/<version>-<id>/ a table of ENTRY rows, and
    commits/<version> names the manifest of a version and its schema.

    That last file is written aside and renamed without overwriting, which is the commit: a reader sees a version whole
    or not at all, a writer that dies leaves nothing behind that is read, and of two writers the later one finds the
    version taken. The rename is atomic on HDFS; on a local disk it is so among the threads of one driver.

    small: bytes of a shard of tier 0; each tier is fan_in times the one before; target: bytes of a merged file.

    Arrivals may differ in columns: the store has those of all of them, and a row is null where its arrival had none.
    A column of another type, or of a name that differs only in case, is refused.
    """

    def __init__(self, spark: SparkSession, root: str, small: int = 16 << 20, target: int = 512 << 20, fan_in: int = 4):
        self.spark, self.root, self.small, self.target, self.fan_in = spark, root.rstrip("/"), small, target, fan_in
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- versions -------------------------------------------------------------------------------------------------

    def _versions(self) -> list[int]:
        at = self._path(f"{self.root}/commits")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The latest committed version; 0 when there is none."""
        return max(self._versions(), default=0)

    def _head(self, version: int) -> dict:
        line = self.spark.read.text(f"{self.root}/commits/{version:08d}", wholetext=True).first()
        return json.loads(line[0])

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/{self._head(version)['manifest']}")

    def _commit(self, version: int, entries: DataFrame, schema: T.StructType) -> int:
        name = f"manifests/{version:08d}-{uuid4().hex}"
        entries.select("shard", "path", "tier", "docs", "bytes").write.parquet(f"{self.root}/{name}")
        body = json.dumps({"manifest": name, "schema": schema.json()})
        aside = self._path(f"{self.root}/commits/aside-{uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(body, "utf-8"))
        finally:
            out.close()
        fs = self._jvm.org.apache.hadoop.fs
        kind = getattr(fs, "Options$Rename")
        plain = self.spark.sparkContext._gateway.new_array(kind, 1)
        plain[0] = kind.NONE
        context = fs.FileContext.getFileContext(aside.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        with _ONE_AT_A_TIME:
            at = self._path(f"{self.root}/commits/{version:08d}")
            if not self._fs.exists(at):
                context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(at), plain)
                return version
        self._fs.delete(aside, False)
        raise Taken(f"version {version} already exists")

    def schema(self, version: int | None = None) -> T.StructType:
        version = self.version() if version is None else version
        return T.StructType.fromJson(json.loads(self._head(version)["schema"])) if version else T.StructType()

    # -- writing --------------------------------------------------------------------------------------------------

    def _tier(self, size):
        """Tier t holds sizes from small * fan_in^(t-1) up to small * fan_in^t; the least tier all that are smaller."""
        ratio = F.greatest(size / F.lit(float(self.small)), F.lit(float(self.fan_in) ** LEAST_TIER))
        return F.ceil(F.round(F.log(ratio) / F.log(F.lit(float(self.fan_in))), 9)).cast("int")

    def _written(self, folder: str, version: int, schema: T.StructType, kind: str = "a") -> DataFrame:
        """ENTRY rows of the files under folder: their footers are read, their pages are not."""
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}").select("_metadata.file_path", "_metadata.file_size")
        path = F.concat(F.lit(f"{folder}/"), F.element_at(F.split("file_path", "/"), -1))
        place = F.concat(F.regexp_extract("file_path", r"part-([0-9]+)", 1), F.regexp_extract("file_path", r"(-c[0-9]+)\.", 1))
        found = rows.groupBy("file_path", "file_size").agg(F.count("*").alias("docs"))
        size = F.col("file_size")
        return found.select(F.concat(F.lit(f"v{version:06d}-{kind}"), place).alias("shard"), path.alias("path"), self._tier(size).alias("tier"), "docs", size.alias("bytes"))

    def _rows_per_shard(self, docs: DataFrame) -> int:
        """Rows that make about ``small`` bytes: by the shards that there are, else by the mean width of the rows."""
        held = self.manifest().agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs")).first()
        if held["docs"]:
            return max(1, self.small * held["docs"] // max(1, held["bytes"]))
        text = [f.name for f in docs.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
        width = sum((F.coalesce(F.octet_length(col(n)), F.lit(0)).cast("double") for n in text), F.lit(8.0 * len(docs.columns)))
        mean = docs.select(F.avg(width)).first()[0]
        return max(1, int(self.small / mean)) if mean else 0

    def append(self, docs: DataFrame, rows_per_shard: int = 0) -> int:
        """Write an arrival as shards of about ``small`` bytes, one or more a task and without a shuffle, and commit them.

        An empty arrival commits a version without new shards. Rows are stored as they are, nulls and repeats too.
        When another writer commits first, the written shards are added to what that one left.
        """
        label = self.version() + 1
        schema = widened(self.schema(), docs.schema)
        folder = f"data/{label:08d}-{uuid4().hex}"
        rows = rows_per_shard or self._rows_per_shard(docs)
        docs.write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(f"{self.root}/{folder}")
        added = settle(self._written(folder, label, docs.schema))
        while True:
            version = self.version()
            schema = widened(self.schema(version), docs.schema)
            try:
                return self._commit(version + 1, self.manifest(version).unionByName(added), schema)
            except Taken:
                continue

    def plan(self) -> DataFrame:
        """The shards to merge, with their run: neighbours of one tier, as many as fill a target-sized file.

        A run waits for more arrivals while it has fewer than fan_in shards and fills less than half a file. It works
        on the manifest, a row per shard, never on documents; a tier of many shards is planned in lanes, so no task
        holds all of them.
        """
        small = self.manifest().filter(F.col("bytes") * 2 <= self.target)
        tiers = small.groupBy("tier").agg(F.count("*").alias("k"), F.sum("bytes").alias("all"))
        lanes = F.greatest(F.lit(1), F.floor(F.col("k") / LANE_SHARDS), F.floor(F.col("all") / F.lit(LANE_FILES * self.target)))
        small = small.join(F.broadcast(tiers.select("tier", lanes.alias("lanes"))), "tier")  # a row a tier
        small = small.withColumn("lane", F.pmod(F.xxhash64("path"), F.col("lanes")))
        before = W.partitionBy("tier", "lane").orderBy("shard", "path").rowsBetween(W.unboundedPreceding, -1)
        full = F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / F.lit(self.target)) + F.floor(F.count("*").over(before) / F.lit(RUN_SHARDS))
        held = small.withColumn("run", F.concat_ws(":", "tier", "lane", full))
        one = W.partitionBy("tier", "lane", "run")
        held = held.withColumn("k", F.count("*").over(one)).withColumn("all", F.sum("bytes").over(one))
        ready = held.filter((F.col("k") >= self.fan_in) | ((F.col("k") > 1) & (F.col("all") * 2 >= self.target)))
        return ready.select("shard", "path", "run", "bytes")

    def compact(self, wave: int = WAVE, rounds: int = 100_000) -> int:
        """Merge until no run is ready; every round is a version. Returns the latest version.

        A round merges up to ``wave`` runs in one job without a shuffle: a run is one task, which reads its shards
        one after another and writes one file. What is not merged is neither read nor touched. When another writer
        commits first, the round is planned anew; its files are left for vacuum().
        """
        for _ in range(rounds):
            before = self.version()
            plan = settle(self.plan())
            names = [r["run"] for r in plan.select("run").distinct().orderBy("run").limit(wave).collect()]
            if not names:
                break
            chosen = plan.filter(F.col("run").isin(names)).select("path", "run").collect()  # wave * RUN_SHARDS names at most
            version, schema = before + 1, self.schema(before)
            folder = f"data/{version:08d}-{uuid4().hex}"
            runs: dict[str, list[str]] = {}
            for row in sorted(chosen, key=lambda r: (r["run"], r["path"])):
                runs.setdefault(row["run"], []).append(f"{self.root}/{row['path']}")
            merged = reduce(DataFrame.union, (self.spark.read.schema(schema).parquet(*paths).coalesce(1) for paths in runs.values()))
            with _separate(self.spark):
                merged.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            gone = self.spark.createDataFrame([(r["path"],) for r in chosen], "path string")
            kept = self.manifest(before).join(gone, "path", "left_anti")
            try:
                self._commit(version, kept.unionByName(self._written(folder, version, schema, "m")), schema)
            except Taken:
                continue
        return self.version()

    def vacuum(self, abandoned: float = ABANDONED) -> None:
        """Drop all versions but the latest, with the shards that only they name.

        Files that no version has named may belong to an arrival that is being written: they go once they are
        ``abandoned`` seconds old. Commits go first, then shards, then manifests, so a vacuum that dies leaves only
        files for the next one.
        """
        versions = self._versions()
        if not versions:
            return
        latest = self.manifest(versions[-1]).select("path")
        heads = [self._head(v)["manifest"] for v in versions[:-1]]
        if heads:
            named = self.spark.read.schema(ENTRY).parquet(*(f"{self.root}/{m}" for m in heads)).select("path").distinct()
            dead = settle(named.join(latest, "path", "left_anti"))
            for old in versions[:-1]:
                self._fs.delete(self._path(f"{self.root}/commits/{old:08d}"), False)
            for row in dead.toLocalIterator():  # a partition of names at a time
                self._fs.delete(self._path(f"{self.root}/{row['path']}"), False)
            for name in heads:
                self._fs.delete(self._path(f"{self.root}/{name}"), True)
        since = time.time() - abandoned
        if self._fs.exists(self._path(f"{self.root}/data")):
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.root}/data")
            old = files.filter(F.col("modificationTime") < F.timestamp_seconds(F.lit(since)).cast("timestamp")).select(F.concat(F.lit("data/"), F.element_at(F.split("path", "/data/"), -1)).alias("path"))
            for row in old.join(latest, "path", "left_anti").toLocalIterator():
                self._fs.delete(self._path(f"{self.root}/{row['path']}"), False)
        alive = self._head(versions[-1])["manifest"].split("/")[-1]
        for folder, kept in (("manifests", alive), ("commits", None)):
            for x in self._fs.listStatus(self._path(f"{self.root}/{folder}")):
                name = x.getPath().getName()
                if name != kept and not name.isdigit() and x.getModificationTime() < since * 1000:
                    self._fs.delete(x.getPath(), True)

    # -- reading --------------------------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, in the columns that the store had then. The driver names its files, as for any scan."""
        version = self.version() if version is None else version
        paths = [f"{self.root}/{r['path']}" for r in self.manifest(version).select("path").toLocalIterator()]
        if not paths:
            return self.spark.createDataFrame([], self.schema(version))
        return self.spark.read.schema(self.schema(version)).parquet(*paths)

    def placed(self, id_col: str = "doc_id") -> DataFrame:
        """One row per stored row: doc_id, shard, tier, shard_docs, version."""
        at = F.col("_metadata.file_path")
        version = self.version()
        rows = self.read(version)
        if not rows.columns or self.manifest(version).isEmpty():
            return self.spark.createDataFrame([], "doc_id long, shard string, tier int, shard_docs long, version long")
        tail = F.concat(F.lit("data/"), F.element_at(F.split(at, "/data/"), -1))
        ids = rows.select(col(id_col).alias("doc_id"), tail.alias("path"))
        joined = ids.join(self.manifest(version), "path")
        return joined.select("doc_id", "shard", "tier", F.col("docs").alias("shard_docs"), F.lit(version).cast("long").alias("version"))


def widened(old: T.StructType, new: T.StructType) -> T.StructType:
    """The columns of both, all nullable, those of old first; a clash of types or of case is an error."""
    held = {f.name.lower(): f for f in old}
    fields = [T.StructField(f.name, f.dataType, True) for f in old]
    for f in new:
        was = held.get(f.name.lower())
        if was is None:
            fields.append(T.StructField(f.name, f.dataType, True))
        elif (was.name, was.dataType.simpleString()) != (f.name, f.dataType.simpleString()):
            raise ValueError(f"column {f.name} {f.dataType.simpleString()} does not go with {was.name} {was.dataType.simpleString()} in the store")
    return T.StructType(fields)


def arrivals(docs: DataFrame, number: int, id_col: str = "doc_id") -> Iterator[DataFrame]:
    """docs in ``number`` parts by ranges of an integer id, which a scan skips by its statistics; null ids come first."""
    i = col(id_col)
    low, high = docs.agg(F.min(i), F.max(i)).first()
    if low is None:
        yield docs
        return
    width = (high - low) // number + 1
    for k in range(number):
        part = (i >= low + k * width) & (i < low + (k + 1) * width)
        yield docs.filter(part | i.isNull() if k == 0 else part)
