"""Tables as immutable Parquet versions: each change is a new version, and old ones can be read.

A version is written to a folder of its own outside of the table and then renamed into place, which one writer only can do. What
a failed write leaves is never read, and blocks nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TableExists(ValueError):
    """A table of that name is there already."""


class NoSuchTable(LookupError):
    """There is no table of that name."""


class WriteConflict(RuntimeError):
    """Another writer has made the version that this one meant to make."""


class Tables:
    """Versioned tables under a root that all executors see; names are case-sensitive."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        at = self._fs_path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at) if s.isDirectory()) if self._fs.exists(at) else []

    def names(self) -> list[str]:
        return [n for n in self._names(self.root) if not n.startswith("_") and self.versions(n)]

    def versions(self, name: str) -> list[int]:
        """Versions whose write was completed."""
        return sorted(int(v.split("=")[1]) for v in self._names(f"{self.root}/{name}") if v.startswith("version=") and self._fs.exists(self._fs_path(f"{self.root}/{name}/{v}/_SUCCESS")))

    def create(self, name: str, schema: str | list[str]) -> None:
        """With a DDL schema, or a list of names for untyped columns (all strings)."""
        if self.versions(name):
            raise TableExists(name)
        ddl = schema if isinstance(schema, str) else ", ".join(f"`{c}` string" for c in schema)
        self.write(name, self.spark.createDataFrame([], ddl))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        made = self.versions(name)
        if not made or (version is not None and version not in made):
            raise NoSuchTable(name if version is None else f"{name} at version {version}")
        return self.spark.read.parquet(f"{self.root}/{name}/version={made[-1] if version is None else version}")

    def write(self, name: str, df: DataFrame) -> int:
        """A new version; readers see it once it is complete, and a writer that loses the race to its number fails."""
        version = max([-1, *(int(v.split("=")[1]) for v in self._names(f"{self.root}/{name}") if v.startswith("version="))]) + 1
        staged, place = self._fs_path(f"{self.root}/_staging/{uuid.uuid4().hex}"), self._fs_path(f"{self.root}/{name}/version={version}")
        try:
            df.write.mode("error").parquet(staged.toString())
            self._fs.mkdirs(place.getParent())
            if self._fs.exists(place) or not self._fs.rename(staged, place):
                raise WriteConflict(f"{name} at version {version}")
            if self._fs.exists(self._fs_path(place, staged.getName())):  # some file systems move into a folder that has come up meanwhile
                self._fs.delete(self._fs_path(place, staged.getName()), True)
                raise WriteConflict(f"{name} at version {version}")
        finally:
            self._fs.delete(staged, True)
        return version

    def drop(self, name: str) -> None:
        if not self.versions(name):
            raise NoSuchTable(name)
        self._fs.delete(self._fs_path(f"{self.root}/{name}"), True)

    def retain(self, name: str, last: int = 2) -> None:
        """Removes all but the last versions."""
        for version in self.versions(name)[:-last]:
            self._fs.delete(self._fs_path(f"{self.root}/{name}/version={version}"), True)

    def backup(self, name: str, to: str) -> None:
        """A copy that restore() can read; `to` must not be there yet."""
        self.read(name).write.mode("error").parquet(to)

    def restore(self, name: str, copy: str) -> int:
        return self.write(name, self.spark.read.parquet(copy))

    def merge_files(self, name: str, file_bytes: int = 128 << 20) -> int:
        """A new version with the same rows in files of about file_bytes, by their size on disk now."""
        made = self.read(name)
        total = self._fs.getContentSummary(self._fs_path(f"{self.root}/{name}/version={self.versions(name)[-1]}")).getLength()
        return self.write(name, made.repartition(max(1, -(-total // file_bytes))))

    def disk_usage(self) -> int:
        """Bytes of all versions of all tables."""
        return sum(self._fs.getContentSummary(self._fs_path(f"{self.root}/{n}")).getLength() for n in self.names())

    def totals(self, stats: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
        """One row (table_count, total_records, total_size, disk_usage, index_count), where stats gives rows by table."""
        each = stats({n: self.read(n) for n in self.names()})
        none = F.lit(0).cast("long")
        return each.agg(
            F.count("*").alias("table_count"),
            *[F.coalesce(F.sum(c), none).alias(to) for c, to in (("n_rows", "total_records"), ("size_bytes", "total_size"))],
            F.lit(self.disk_usage()).cast("long").alias("disk_usage"),
            F.coalesce(F.sum("index_count"), none).alias("index_count"),
        )

    def describe(self, name: str) -> DataFrame:
        fields = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(self.read(name).schema)]
        return self.spark.createDataFrame(fields, "position int, column string, type string")

    def list_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self.names()], "name string").orderBy(F.col("name"))
