"""State tables: a watermark, and the ids that have been seen.

A table is a folder of versions.  A write puts a new folder in place by one
rename, under a name that no other has, so that a reader meets the old state or the
new one and never a part or none.  A version is named by the batch that wrote it and
by how often it was written; only the last writing of a version counts, so that a
batch that runs again after a failure replaces its own version and changes nothing else.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.schemas import SEEN_IDS, WATERMARK

#: Where ids start when there is no state yet.
FIRST_ID = 16_000


class StateFolder:
    """Versions below a path in any store that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        return sorted(self._writings())

    def _writings(self) -> dict[int, list[int]]:
        """The writings of each version, oldest first."""
        found: dict[int, list[int]] = {}
        if self._fs.exists(self._path(self.path)):
            for status in self._fs.listStatus(self._path(self.path)):
                if named := re.fullmatch(r"v=(\d+)(?:\.(\d+))?", status.getPath().getName()):
                    found.setdefault(int(named[1]), []).append(int(named[2] or 0))
        return {v: sorted(n) for v, n in found.items()}

    def _place(self, version: int, writing: int) -> str:
        return f"{self.path}/v={version}.{writing}" if writing else f"{self.path}/v={version}"

    def write(self, rows: DataFrame, version: int) -> None:
        """Writes beside, then renames to a new name; what it replaces goes after that."""
        before = self._writings().get(version, [])
        beside, place = f"{self.path}/_writing-{version}", self._place(version, before[-1] + 1 if before else 0)
        rows.write.mode("overwrite").parquet(beside)
        if not self._fs.rename(self._path(beside), self._path(place)):
            raise OSError(f"state {place} could not be put in place")
        for writing in before:
            self._fs.delete(self._path(self._place(version, writing)), True)

    def read(self, versions: list[int], schema: str) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], schema)
        last = self._writings()
        return self.spark.read.schema(schema).parquet(*(self._place(v, last[v][-1]) for v in versions))

    def drop(self, versions: list[int]) -> None:
        for v, writings in self._writings().items():
            if v in versions:
                for writing in writings:
                    self._fs.delete(self._path(self._place(v, writing)), True)


class Watermark:
    """The largest id so far; it never falls."""

    def __init__(self, spark: SparkSession, path: str, default: int = FIRST_ID):
        self.folder, self.default = StateFolder(spark, path), default

    def get(self) -> int:
        versions = self.folder.versions()
        row = self.folder.read(versions[-1:], WATERMARK).agg(F.max("last_id")).first()
        return self.default if row[0] is None else row[0]

    def advance(self, last_id: int, batch_id: int) -> int:
        """Writes the larger of the stored and the given id; older versions but one go."""
        now = max(self.get(), last_id)
        versions = self.folder.versions()
        version = max([batch_id, *versions])
        self.folder.write(self.folder.spark.range(1).select(F.lit(now).cast("long").alias("last_id")), version)
        self.folder.drop(self.folder.versions()[:-2])
        return now


class SeenIds:
    """Ids that were processed, one version for each batch until there are ``most_versions``, which are then made one."""

    def __init__(self, spark: SparkSession, path: str, most_versions: int = 50):
        self.folder, self.most_versions = StateFolder(spark, path), most_versions

    def get(self, before_batch: int | None = None) -> DataFrame:
        """The distinct ids, of batches before one if it is given: what that batch met when it first ran."""
        rows = self.folder.read(self.folder.versions(), SEEN_IDS)
        return (rows if before_batch is None else rows.where(F.col("batch_id") < before_batch)).select("data_id").distinct()

    def add(self, ids: DataFrame, batch_id: int) -> None:
        self.folder.write(ids.select(F.col("data_id").cast("string"), F.lit(batch_id).cast("long").alias("batch_id")), batch_id)
        if len(self.folder.versions()) > self.most_versions:
            self.compact()

    def compact(self) -> None:
        """All versions but the last become one, named as the newest of them; each id with the batch that saw it first."""
        old = self.folder.versions()[:-1]
        if len(old) > 1:
            ids = self.folder.read(old, SEEN_IDS).groupBy("data_id").agg(F.min("batch_id").alias("batch_id"))
            self.folder.write(ids, old[-1])
            self.folder.drop(old[:-1])
