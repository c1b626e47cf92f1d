"""A table for look-ups by key, which skip what cannot hold the key before they read it.

Rows lie in folders by a hash of their key, sorted by it.  A look-up lists one folder; of its files the
statistics of the sorted key and a Parquet Bloom filter leave the row groups that may hold the key.  All of the table
is put in place by one commit, so that readers meet the old rows until the new ones are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions.text import folded_key
from noticelake.sources.commits import WRITE, CommitLog

KEY, BUCKET, TABLE = "__key", "__bucket", "table"


class KeyedTable:
    """Rows of a schema by its column ``key``.

    ``folded`` keys are texts of which case and outer white space do not count.  Rows that share a key are all found; a null
    key is stored, finds nothing and is found by nothing.  ``buckets`` is fixed when the table is first written and
    belongs to the size: a folder is what a look-up lists.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64, folded: bool = False):
        self.spark, self.log, self.key, self.buckets, self.folded = spark, CommitLog(spark, path), key, buckets, folded
        self.fields = spark.createDataFrame([], schema).schema.fields
        self.columns = [F.col(f"`{f.name}`") for f in self.fields]
        kind = "string" if folded else next(f.dataType for f in self.fields if f.name == key).simpleString()
        self.kind, self.stored = kind, f"{schema}, {KEY} {kind}, {WRITE} string, {BUCKET} int"

    @classmethod
    def of(cls, rows: DataFrame, path: str, key: str, **more) -> KeyedTable:
        """A table at a new path that holds these rows and has their schema."""
        made = cls(rows.sparkSession, path, rows.schema.toDDL(), key, **more)
        made.write(rows)
        return made

    def _key(self, value: Column) -> Column:
        return folded_key(value) if self.folded else value.cast(self.kind)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame) -> int:
        """All of the table anew; columns that rows lack are null.  Returns the version.

        Rows are dealt by ranges of (folder, key, hash of the row), so that a key with a third of all rows is many files and a
        file has few keys.
        """
        held = rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.fields))
        held = held.withColumn(KEY, self._key(F.col(f"`{self.key}`")))
        held = held.withColumn(BUCKET, self._bucket(F.col(KEY)))
        told = F.xxhash64(*(F.to_json(F.struct(c)) if f.dataType.typeName() in ("map", "variant") else c for f, c in zip(self.fields, self.columns, strict=True)))
        dealt = held.repartitionByRange(BUCKET, KEY, told).sortWithinPartitions(BUCKET, KEY)
        bloom = {f"parquet.bloom.filter.enabled#{KEY}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}  # as large as a row group's keys need
        new = self.log.written(dealt, TABLE, partition_by=(BUCKET,), options=bloom)
        return self.log.commit(lambda now: ([new], [e.folder for e in now.of(TABLE)])).version

    def _stored(self, version: int | None) -> DataFrame:
        return self.log.read(self.stored, self.log.snapshot(version).entries, basePath=f"{self.log.path}/data")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows as of a version, by default the newest."""
        return self._stored(version).select(*self.columns)

    def get(self, value, version: int | None = None) -> DataFrame:
        """The rows of one key; other folders are not listed."""
        key = self._key(F.lit(value))
        return self._stored(version).where((F.col(BUCKET) == self._bucket(key)) & (F.col(KEY) == key)).select(*self.columns)

    def get_many(self, wanted: DataFrame, col: str, version: int | None = None) -> DataFrame:
        """The rows of any of the keys in a column of ``wanted``, each once; only folders in which keys can lie are listed."""
        keys = wanted.select(self._key(F.col(f"`{col}`")).alias("__wanted")).where("__wanted is not null").distinct().withColumn("__in", self._bucket(F.col("__wanted")))
        folders = [r[0] for r in keys.select("__in").distinct().collect()]  # at most as many as there are buckets
        here = self._stored(version).where(F.col(BUCKET).isin(folders))
        return here.join(keys, (F.col(KEY) == F.col("__wanted")) & (F.col(BUCKET) == F.col("__in")), "left_semi").select(*self.columns)
