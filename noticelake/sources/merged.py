"""A table by key that is merged when it is read: a base in buckets, and small deltas beside it.

A change writes its own rows and nothing else: new rows by key, or keys that are gone.  A reader takes
each key's newest delta, and of the base what no delta has.  When deltas have grown to a share of the base, all of it
becomes a new base in one commit.  Commits are those of :mod:`noticelake.sources.commits`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions.text import folded_key
from noticelake.operators.users import judged, one_each, unapplied
from noticelake.sources.commits import WRITE, CommitConflict, CommitLog, Entry, Snapshot
from noticelake.store import written

BASE, DELTA = "base", "delta"
OWN = f"__key string, __gone boolean, {WRITE} string, __bucket int"


class MergedUsers:
    """Users (a schema with ``email``) by their address, case and outer white space aside.

    ``buckets`` is fixed when the table is first written; a look-up reads the files of one.  ``most_deltas`` and
    ``share`` say when :meth:`settle` makes a new base.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 16, most_deltas: int = 20, share: float = 0.1):
        self.log, self.schema, self.buckets, self.most_deltas, self.share = CommitLog(spark, path), schema, buckets, most_deltas, share
        self.fields = spark.createDataFrame([], schema).schema.fields
        self.columns = [f.name for f in self.fields]

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _held(self, rows: DataFrame, gone: bool) -> DataFrame:
        """Rows as they are stored; columns that they lack are null."""
        key = folded_key("email")
        kept = rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.fields), key.alias("__key"), F.lit(gone).alias("__gone"))
        return kept.withColumn("__bucket", self._bucket(F.col("__key")))

    def _write(self, rows: DataFrame, key: str, gone: bool = False) -> Entry:
        held = self._held(rows, gone).repartition("__bucket")
        return self.log.written(held, key, partition_by=("__bucket",))

    def _merged(self, now: Snapshot, bucket: Column | None = None) -> DataFrame:
        """(columns, __key) of a version, or of one bucket of it."""

        def stored(entries: list[Entry]) -> DataFrame:
            rows = self.log.read(f"{self.schema}, {OWN}", entries, basePath=f"{self.log.path}/data")
            return rows if bucket is None else rows.where(F.col("__bucket") == bucket)

        base = stored(now.of(BASE))
        deltas = [e for e in now.of(DELTA) if e.rows]
        columns = [F.col(f"`{c}`") for c in self.columns]
        if not deltas:
            return base.select(*columns, "__key")
        at = F.create_map(*(F.lit(x) for e in deltas for x in (e.folder.rsplit("=", 1)[-1], e.version)))  # as many as there are deltas
        rows = stored(deltas).withColumn("__at", at[F.col(WRITE)])
        last = rows.groupBy("__key").agg(F.max_by(F.struct(*columns, "__gone"), "__at").alias("r")).select("r.*", "__key")
        rest = base.join(last.select("__key"), "__key", "left_anti")
        return rest.select(*columns, "__key").unionByName(last.where("not __gone").select(*columns, "__key"))

    def read(self, version: int | None = None) -> DataFrame:
        """All users as of a version, by default the newest."""
        return self._merged(self.log.snapshot(version)).select(*(F.col(f"`{c}`") for c in self.columns))

    def lookup(self, email: str) -> DataFrame:
        """The user of an address; reads one bucket."""
        key = folded_key(F.lit(email))
        return self._merged(self.log.snapshot(), self._bucket(key)).where(F.col("__key") == key).select(*(F.col(f"`{c}`") for c in self.columns))

    def create(self, users: DataFrame) -> DataFrame:
        """A new table of these users; returns those that share an address with a later row or have none, with ``reason``."""
        new = self._write(one_each(users), BASE)

        def change(now: Snapshot) -> tuple[list[Entry], list[str]]:
            if now.version:
                raise CommitConflict(f"{self.log.path} is there already")
            return [new], []

        self.log.commit(change)
        return unapplied(users)

    def upsert(self, changes: DataFrame, order: str | None = None) -> DataFrame:
        """Adds users and replaces those of the same address; returns the changes that are not applied, with ``reason``."""
        new = self._write(one_each(changes, order), DELTA)
        self.log.commit(lambda _: ([new], []))
        return unapplied(changes, order)

    def delete(self, gone: DataFrame) -> None:
        """Users of these addresses go; other columns are not read."""
        new = self._write(one_each(gone.select("email")), DELTA, gone=True)
        self.log.commit(lambda _: ([new], []))

    def register(self, new: DataFrame, order: str | None = None, attempts: int = 5) -> DataFrame:
        """Adds users whose address is free; returns the others with ``reason``.

        If another writer commits meanwhile, it is decided again whose address is free.
        """
        for _ in range(attempts):
            now = self.log.snapshot()
            told = written(judged(self._merged(now).select(F.col("__key").alias("email")), new, order), "registrations")
            entry = self._write(told.where("reason is null").drop("reason"), DELTA)

            def change(then: Snapshot, base: int = now.version, entry: Entry = entry) -> tuple[list[Entry], list[str]]:
                if then.version != base:
                    raise CommitConflict(self.log.path)
                return [entry], []

            try:
                self.log.commit(change, attempts=1)
            except CommitConflict:
                continue
            return told.where("reason is not null")
        raise CommitConflict(f"{self.log.path}: {attempts} other commits came between")

    def settle(self, force: bool = False) -> bool:
        """Makes a new base where deltas are many or large; changes that are committed meanwhile stay deltas of it."""
        now = self.log.snapshot()
        base, deltas = now.of(BASE), now.of(DELTA)
        large = sum(e.rows for e in deltas) > self.share * sum(e.rows for e in base)
        if not deltas or not (force or large or len(deltas) > self.most_deltas):
            return False
        new = self._write(self._merged(now), BASE)
        replaced = [e.folder for e in base + deltas]

        def change(then: Snapshot) -> tuple[list[Entry], list[str]]:
            if not set(replaced) <= {e.folder for e in then.entries}:
                raise CommitConflict(f"{self.log.path} was settled by another writer")
            return [new], replaced

        self.log.commit(change)
        return True

