"""Mounts: sources attached below a root, as partitions of one table of files."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import in_scope
from . import readers

#: What may be done with a mount: names only, links, or everything.
ANALYSES = ("off", "links", "full")


class Workspace:
    """Files of all mounts under root/files, a partition for each mount; root/mounts is the list of mounts.

    Importing a mount again replaces its partition and no other; removing it deletes the partition. Every change is
    a write of whole partitions, so a lost task leaves nothing behind.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def add(self, mount: str, files: DataFrame, kind: str = "import", analysis: str = "full") -> None:
        """Attach or refresh a mount; files has uri, mime, text."""
        if analysis not in ANALYSES:
            raise ValueError(f"analysis is one of {', '.join(ANALYSES)}")
        rows = files.select("uri", "mime", "text", F.octet_length("text").cast("long").alias("byte_size"), F.lit(kind).alias("kind"), F.lit(analysis).alias("analysis"))
        rows.write.mode("overwrite").parquet(self._at(mount))

    def add_folder(self, mount: str, folder: str, glob: str | None = None, **options: str) -> None:
        """Attach a directory, or any store that Spark reads."""
        texts = readers.texts(self.spark, folder, mount, glob)
        extension = F.lower(F.regexp_extract("uri", r"(\.[^./]+)$", 1))
        mime = F.lit("application/octet-stream")
        for ext, name in readers.MIMES.items():
            mime = F.when(extension == ext, F.lit(name)).otherwise(mime)
        self.add(mount, texts.withColumn("mime", mime), **options)

    def add_git(self, mount: str, url: str, into: str | None = None, ref: str | None = None, **options: str) -> None:
        """Clone a repository and attach it; needs git on the driver and, for remote addresses, a network.

        git writes to a folder of the driver alone, from which the tree is copied to the shared folder into (by
        default one of the workspace, gone when the files are indexed). Executors read that copy only.
        """
        shared = into or f"{self.root}/clones/{mount.encode().hex()}"
        fs = self._path(shared).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        with tempfile.TemporaryDirectory() as local:
            command = ["git", "clone", "--depth", "1", *(["--branch", ref] if ref else []), "--", url, f"{local}/tree"]
            subprocess.run(command, check=True, capture_output=True)
            shutil.rmtree(f"{local}/tree/.git")
            if into is None:
                fs.delete(self._path(shared), True)
            fs.copyFromLocalFile(False, False, self._path(f"file://{local}/tree"), self._path(shared))
        self.add_folder(mount, shared, "*.*", **options)
        if into is None:
            fs.delete(self._path(shared), True)

    def _at(self, mount: str) -> str:
        return f"{self.root}/files/mount=m{mount.encode().hex()}"

    def mounts(self) -> list[str]:
        at = self._path(f"{self.root}/files")
        if not self._fs.exists(at):
            return []
        return sorted(bytes.fromhex(x.getPath().getName().removeprefix("mount=m")).decode() for x in self._fs.listStatus(at) if x.getPath().getName().startswith("mount="))

    def files(self, pattern: str | None = None) -> DataFrame:
        """uri, mime, text, byte_size, kind, analysis, mount of everything, or of what is in scope; mounts that cannot match are not read."""
        held = self.mounts()
        if not held:
            return self.spark.createDataFrame([], "uri string, mime string, text string, byte_size long, kind string, analysis string, mount string")
        rows = self.spark.read.option("basePath", f"{self.root}/files").parquet(*map(self._at, held))
        rows = rows.withColumn("mount", F.decode(F.unhex(F.substring("mount", F.lit(2), F.length("mount"))), "utf-8"))
        return rows.filter(in_scope(F.col("uri"), pattern)) if pattern else rows

    def listing(self) -> DataFrame:
        """mount, kind, analysis, file_count, byte_size."""
        return self.files().groupBy("mount", "kind", "analysis").agg(F.count("*").alias("file_count"), F.sum("byte_size").cast("long").alias("byte_size"))

    def remove(self, mount: str) -> bool:
        """Detach a mount: its indexed rows go, its source is not touched."""
        return self._fs.delete(self._path(self._at(mount)), True)

    def reindex(self, pattern: str, mount: str, source: DataFrame) -> None:
        """Take the files in scope anew from source and keep the others of the mount as they are."""
        hit = in_scope(F.col("uri"), pattern)
        old = self.spark.read.parquet(self._at(mount))
        held = old.filter(~hit).select("uri", "mime", "text")
        kind = old.select("kind", "analysis").limit(1).collect()
        staged = f"{self.root}/staged-{mount.encode().hex()}"
        held.unionByName(source.filter(hit).select("uri", "mime", "text")).write.mode("overwrite").parquet(staged)
        options = {"kind": kind[0]["kind"], "analysis": kind[0]["analysis"]} if kind else {}
        self.add(mount, self.spark.read.parquet(staged), **options)
        self._fs.delete(self._path(staged), True)


def marker(start: str, name: str = ".corvane") -> Path:
    """The workspace of a folder: the nearest git root above, else the nearest marker, else a new marker here."""
    here = Path(start).resolve()
    above = [here, *here.parents]
    for wanted in (".git", name):
        for folder in above:
            if (folder / wanted).exists():
                return folder
    (here / name).mkdir(exist_ok=True)
    return here
