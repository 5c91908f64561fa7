"""Intermediate results written to the cluster's shared checkpoint folder."""

import re
import tempfile
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Only a local session may do without it: there a temporary folder is made
    once and kept in the session's configuration.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = spark.conf.get("linkloom.local.checkpoint.dir", None)
        if folder is None:
            folder = tempfile.mkdtemp(prefix="linkloom-")
            spark.conf.set("linkloom.local.checkpoint.dir", folder)
    return folder.rstrip("/")


def located(spark: SparkSession, folder: str) -> str:
    """URI of a folder, which is made if need be, in the store that holds it.

    A path without a scheme lies in Spark's default file system, as for Spark's own
    readers and writers; mounts (``viewfs``) are followed to what they show.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    return system.resolvePath(path).toUri().toString()


def existing(spark: SparkSession, pattern: str) -> list[tuple[str, str, bool]]:
    """(path, URI in the store that holds it, whether it is a folder) of what a path or a pattern names for Spark's readers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [
        (status.getPath().toString(), system.resolvePath(status.getPath()).toUri().toString(), status.isDirectory())
        for status in system.globStatus(path) or ()
    ]


class RunFolder:
    """Tables of one run, in a folder of their own.

    A written table cuts lineage, is read again from shared storage when an
    executor is lost, and gives later joins its true size.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.name = f"{label}_{uuid.uuid4().hex}"
        self.path = f"{checkpoint_folder(spark)}/{self.name}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.path}/{table}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_bucketed(
        self, df: DataFrame, table: str, key: str, buckets: int
    ) -> DataFrame:
        """Keep a table bucketed by ``key``, so that joins on it need no shuffle.

        ``df`` must be hash-partitioned by ``key`` into ``buckets``; then every
        task writes one bucket.
        """
        name = f"{self.name}_{table}"
        (
            df.write.option("path", f"{self.path}/{table}")
            .bucketBy(buckets, key)
            .sortBy(key)
            .saveAsTable(name)
        )
        return self.spark.table(name)

    def forget_bucketed(self, table: str) -> None:
        """Drop the catalog entry; the files stay in the run folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")


def remove_old_runs(spark: SparkSession, hours: float = 168.0) -> int:
    """Delete the run folders that were made more than ``hours`` ago; how many.

    A result is read from its run's tables, so a run must have been used up by
    then. Other folders of the checkpoint folder are left alone.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(checkpoint_folder(spark))
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    before = (time.time() - 3600 * hours) * 1000
    removed = 0
    for status in system.listStatus(root) if system.exists(root) else ():
        name = status.getPath().getName()
        if re.fullmatch(r"[a-z_]+_[0-9a-f]{32}", name) and status.isDirectory() and status.getModificationTime() < before:
            removed += bool(system.delete(status.getPath(), True))
    return removed


class Commits:
    """The versions of something that consists of several tables or files.

    A version counts from the moment that a small file names it, which appears whole
    or not at all. What it consists of is written before that, under names of its own, so that
    readers see the old version or the new one and never a part of either. One
    writer commits at a time.
    """

    _SCHEMA = "version long, facts map<string, string>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = f"{path.rstrip('/')}/commits"

    def latest(self) -> tuple[int, dict[str, str]] | None:
        """Number and facts of the last version; None before the first."""
        try:
            found = self.spark.read.schema(self._SCHEMA).json(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        last = found.orderBy(F.desc("version")).first()
        return None if last is None else (last["version"], last["facts"])

    def commit(self, version: int, **facts: str) -> None:
        row = self.spark.createDataFrame([(version, facts)], self._SCHEMA)
        row.coalesce(1).write.mode("append").json(self.path)


def numbered(run: RunFolder, ordered: DataFrame, name: str) -> DataFrame:
    """The rows of a sorted DataFrame with their number from 0, in no order of their own.

    The sorted rows are kept with their partition and their number in it. Only the
    sizes of partitions meet in one place, a row for each.
    """
    place = F.monotonically_increasing_id()
    part, nth = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    rows = run.keep(ordered.withColumn("_place", place), f"{name}_rows").withColumns({"_part": part, name: nth})
    sizes = sorted(rows.groupBy("_part").count().collect())
    before, starts = 0, []
    for part, size in sizes:
        starts.append((part, before))
        before += size
    offsets = run.spark.createDataFrame(starts, "_part long, _before long")
    # As many rows as the sort had partitions.
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_place", "_part", "_before")
