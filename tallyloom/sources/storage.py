"""Parquet tables in versions: a new version is written beside the old one, and is current once it is whole.

Parquet has no row updates, and a path must not be overwritten while it is read. Folders are reached by
Hadoop's file systems only, so that any store Spark reads will do.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyloom import schema


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a folder of our own, but only on a local master: executors elsewhere would each write to
    their own disk.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", given)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tallyloom-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class NotRefreshed(RuntimeError):
    """The table has no version yet."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, ddl: str | None = None, keep: int = 2):
        self.spark, self.path, self.ddl, self.keep = spark, path.rstrip("/"), ddl, keep
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Whole versions, oldest first: those whose writer has left its mark."""
        root = self._hadoop(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._hadoop(f"{self.path}/{n}/_SUCCESS")))

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self) -> DataFrame:
        """The current version; an empty table if there is none but a schema; else NotRefreshed."""
        have = self.versions()
        if have:
            return self.spark.read.parquet(f"{self.path}/v{have[-1]}")
        if self.ddl:
            return self.spark.createDataFrame([], self.ddl)
        raise NotRefreshed(f"{self.path} was never refreshed")

    def append(self, df: DataFrame, tag: str | None = None) -> DataFrame:
        """Adds files to the current version: what is there isn't read or written again. df may read the table as it was.

        With a tag the files carry it in their names, so that withdraw() finds them if the same append is made again.
        """
        have = self.versions()
        current = f"{self.path}/v{have[-1] if have else 0}"
        if tag is None or not have:  # a first version counts once it is whole, so nothing needs withdrawing from it
            df.write.mode("append" if have else "overwrite").parquet(current)
            return self.read()
        beside = f"{self.path}/adding-{tag}"
        df.write.mode("overwrite").parquet(beside)
        for file in self._fs.listStatus(self._hadoop(beside)):
            if file.getPath().getName().startswith("part-"):
                self._fs.rename(file.getPath(), self._hadoop(f"{current}/{tag}-{file.getPath().getName()}"))
        self._fs.delete(self._hadoop(beside), True)
        return self.read()

    def withdraw(self, tag: str) -> None:
        """Takes out the files that an append with this tag has added to the current version."""
        for version in self.versions()[-1:]:
            for file in self._fs.listStatus(self._hadoop(f"{self.path}/v{version}")):
                if file.getPath().getName().startswith(f"{tag}-part-"):
                    self._fs.delete(file.getPath(), False)

    def replace(self, df: DataFrame) -> DataFrame:
        """Writes the next version and drops those older than the last few; df may read the current one."""
        have = self.versions()
        number = have[-1] + 1 if have else 0
        df.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        for old in have[: -(self.keep - 1) or None]:
            self._fs.delete(self._hadoop(f"{self.path}/v{old}"), True)
        return self.read()


class Store:
    """The named tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}", None if name == "collection_stats" else schema.TABLES[name])

    def read(self, name: str) -> DataFrame:
        return self.table(name).read()

    def register(self, *names: str) -> None:
        """Temporary views of the current versions."""
        for name in names or schema.TABLES:
            if self.table(name).exists() or name != "collection_stats":
                self.read(name).createOrReplaceTempView(name)
