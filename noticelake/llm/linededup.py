"""Line deduplication over levelled sorted runs of line hashes.

The runs are a log-structured store of tables bucketed and sorted by line hash,
and a hash lives in exactly one of them.  Each batch of documents meets the runs
in merge joins, bucket by bucket and without moving them: hashes that an anti
join finds in no run become a new run, and those that a run holds are laid beside
it as an update of its counts.  A level that holds ``fanout`` runs is compacted
into one run of the next level before more come, updates included.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm.common import SPACES, ascii_lower, fresh_path, remove, written


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hash(key: Column) -> Column:
    """128 bits, so that a corpus of 1e12 lines meets no accident."""
    # the constant comes first: each argument is hashed with the hash so far as its seed, so after the key it would add nothing
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def _keys(text: Column, least: int) -> Column:
    """The hashes of a text's distinct keys of at least that many code points."""
    keys = F.transform(F.split(text, "\n"), line_key)
    # distinct as strings, which Spark finds by hashing; structs it would compare in pairs
    return F.transform(F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= least)), _hash)


HASH = ["h1", "h2"]
RUN = "h1 long, h2 long, n_docs long, max_id long"


@dataclass
class Run:
    """A table of hashes that no other run holds, and tables of what later batches add to their counts."""

    name: str
    updates: list[str] = field(default_factory=list)


class LineRuns:
    """Rows (h1, h2, n_docs, max_id) by line hash, each hash in one run."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[Run]] = [[]]
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        """A bucketed and sorted table; the rows must be dealt by bucket already."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = fresh_path(self.spark, name)
        rows.select("h1", "h2", "n_docs", "max_id").write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", self.paths[name]).saveAsTable(name)
        return name

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, *HASH)

    def _table(self, name: str) -> DataFrame:
        return self.spark.table(name).hint("merge")

    @property
    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def _current(self, run: Run) -> DataFrame:
        """A run's rows with its updates merged in, bucket by bucket."""
        rows = self._table(run.name)
        for name in run.updates:
            more = self._table(name).select(*HASH, F.col("n_docs").alias("more"), F.col("max_id").alias("later"))
            rows = rows.join(more, HASH, "left").select(*HASH, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("max_id", "later").alias("max_id"))
        return rows

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch (h1, h2, ...) whose hash no run holds: one merge anti join for each run."""
        for run in self.runs:
            batch = batch.join(self._table(run.name).select(*HASH), HASH, "left_anti")
        return batch

    def seen(self, batch: DataFrame, run: Run) -> DataFrame:
        """Rows of a batch whose hash the run holds."""
        return batch.join(self._table(run.name).select(*HASH), HASH, "left_semi")

    def _compact(self) -> None:
        """Full levels become one run of the next level, and a run's many updates one."""
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                old, self.levels[k] = self.levels[k], []
                # runs share no hash, so they are put together and not merged
                self.levels[k + 1].append(Run(self._write(self._dealt(reduce(DataFrame.unionByName, map(self._current, old))))))
                self._remove([name for run in old for name in (run.name, *run.updates)])
        for run in self.runs:
            if len(run.updates) >= self.fanout:
                # by path: Spark 4.1 groups a union of bucketed tables without the exchange that it needs
                rows = self.spark.read.schema(RUN).parquet(*(self.paths[n] for n in run.updates))
                old, run.updates = run.updates, [self._write(self._dealt(rows.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("max_id").alias("max_id"))))]
                self._remove(old)

    def add(self, batch: DataFrame) -> None:
        """Compacts what is full, then adds a batch (h1, h2, id) of one row for each document and key."""
        self._compact()
        name = self._write(self._dealt(batch.groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("id").alias("max_id"))))
        if not self.runs:
            self.levels[0].append(Run(name))
            return
        rows = self._table(name)
        new = Run(self._write(self.unseen(rows)))
        for run in self.runs:
            run.updates.append(self._write(self.seen(rows, run)))
        self.levels[0].append(new)
        self._remove([name])

    def _remove(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")
            remove(self.spark, self.paths.pop(name))

    def drop(self) -> None:
        """Gives up all runs with their tables and files."""
        self._remove(list(self.paths))
        self.levels = [[]]

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, max_id) of every key over all batches: the runs as they are, since each key is in one."""
        if not self.runs:
            return self.spark.createDataFrame([], RUN)
        return reduce(DataFrame.unionByName, map(self._current, self.runs))


def _by_remainder(drops: Column) -> Column:
    """An array of hashes as about the square root of its size of arrays, by remainder, so that each is searched quickly."""
    n = F.ceil(F.sqrt(F.size(drops))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.filter(drops, lambda h: F.pmod(h["h1"], n) == k))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5, batches: int = 3, fanout: int = 2) -> DataFrame:
    """``docs`` with text replaced by the kept lines, and n_lines, n_dropped.

    A line's key is the line without outer ASCII white space, A-Z lowered.  Keys
    of at least ``least_chars`` found in at least ``least_docs`` rows lose all
    their lines but those in rows with the largest id that holds them.  A null
    text is one empty line.  Rows that repeat an id each count, and keep or lose
    alike; rows without an id count but lose nothing.  Other columns pass
    through; n_lines and n_dropped replace columns of that name.  No rows give
    none.  Only the hashes of lines are shuffled to find repeats, and each text
    once, at every size, to meet its drops.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c == text_col else F.col(f"`{c}`") for c in names))
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    lines = docs.select(ident.alias("id"), F.pmod(F.xxhash64(ident), F.lit(batches)).cast("int").alias("batch"), F.explode(_keys(text, least_chars)).alias("h"))
    keys = written(lines.select("id", "h.h1", "h.h2", "batch"), "line-keys", ("batch",))
    runs = LineRuns(docs.sparkSession, fanout)
    try:
        for k in range(batches):
            runs.add(keys.where(F.col("batch") == k))
        common = written(runs.totals().where(F.col("n_docs") >= least_docs).select(*HASH, "max_id"), "common-lines")
    finally:
        runs.drop()
    losing = keys.join(common, HASH).where("id <> max_id").groupBy("id").agg(F.collect_set(F.struct(*HASH)).alias("drops"))
    losing = written(losing.select(F.col("id").alias("__id"), _by_remainder(F.col("drops")).alias("__drops")), "drops")
    split = F.split(text, "\n")

    def hash_of_long(line):
        return F.transform(F.array(line_key(line)), lambda k: F.when(F.char_length(k) >= least_chars, _hash(k)))[0]  # the key is made once

    def unless_dropped(line, h):
        drops = F.get("__drops", F.pmod(h["h1"], F.size("__drops")).cast("int"))
        return F.when(h.isNull() | ~F.array_contains(drops, h), line)

    kept = F.when(F.col("__drops").isNotNull(), F.array_compact(F.zip_with(split, F.transform(split, hash_of_long), unless_dropped)))
    joined = docs.join(losing.hint("merge"), ident == F.col("__id"), "left").withColumn("__kept", kept).withColumn("n_lines", F.size(split).cast("long"))
    joined = joined.withColumn("n_dropped", F.when(F.col("__kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("__kept")).cast("long"))
    new_text = F.when(F.col("__kept").isNull(), text).otherwise(F.array_join("__kept", "\n"))
    return joined.select(*(new_text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names), "n_lines", "n_dropped")
