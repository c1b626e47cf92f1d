"""Recorded runs: files that hold a JSON array each, and runs of JSON lines that a log of commits names."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.schemas import RUN_NOTICE
from noticelake.sources.commits import LOG, CommitLog

PROCESSED = "processed_"
LISTED = "path string, modificationTime timestamp, length long, name string, run string"


@dataclass(frozen=True)
class Run:
    """A run: its name, when it was recorded (milliseconds), the files or folders that hold it, and whether these are arrays."""

    name: str
    at: int
    paths: tuple[str, ...]
    arrays: bool
    n_files: int
    length: int


def _files(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """(path, milliseconds, bytes) of the files of a folder and below; files without bytes are there, what begins with _ or . is not.

    A listing by the file system, as Spark's own scans make one before they leave empty files out.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, left = [], [top] if fs.exists(top) else []
    while left:
        for status in fs.listStatus(left.pop()):
            if status.getPath().getName()[0] not in "_.":
                if status.isDirectory():
                    left.append(status.getPath())
                else:
                    found.append((status.getPath().toString(), status.getModificationTime(), status.getLen()))
    return found


def _log(spark: SparkSession, folder: str) -> CommitLog:
    return CommitLog(spark, f"{folder.rstrip('/')}/{LOG}runs", "json")  # its name keeps it out of listings of files


def run_list(spark: SparkSession, folder: str) -> list[Run]:
    """All runs on record, oldest first, of equal times by name: array files, and what the log of commits names.

    Runs without rows are runs.  What a writer left without a commit is none.
    """
    arrays = [Run(path, at, (path,), True, 1, size) for path, at, size in _files(spark, folder) if path.endswith(".json")]
    log = _log(spark, folder)
    entries = log.snapshot().entries
    lines = [Run(e.key, e.meta.get("at") or e.at, tuple(log.paths([e])) if e.rows else (), False, e.meta["n_files"], e.meta["length"]) for e in entries]
    return sorted(arrays + lines, key=lambda r: (r.at, r.name))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, name, run) of the array files; those without bytes and empty arrays are there too."""
    rows = [(r.name, r.at / 1000, r.length, r.name.rsplit("/", 1)[-1], r.name) for r in run_list(spark, folder) if r.arrays]
    kinds = LISTED.replace("modificationTime timestamp", "modificationTime double")
    return spark.createDataFrame(rows, kinds).withColumn("modificationTime", F.timestamp_seconds("modificationTime"))


def contents(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """(path, name, content) of array files as text, by default of all that are pending; a file without bytes is an empty text."""
    files = pending(spark, folder) if files is None else files
    sizes = [(r.path, r.name, r.length) for r in files.select("path", "name", "length").collect()]  # names, as the driver lists them for any read
    empty = spark.createDataFrame([(p, n, "") for p, n, size in sizes if not size], "path string, name string, content string")
    full = [p for p, _, size in sizes if size]
    if not full:
        return empty
    read = spark.read.format("binaryFile").load(full)
    return empty.unionByName(read.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("content")))


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """(run, at, n_files, length) of each run: when it was recorded, its files and their bytes."""
    rows = [(r.name, r.at / 1000, r.n_files, r.length) for r in run_list(spark, folder)]
    return spark.createDataFrame(rows, "run string, at double, n_files long, length long").withColumn("at", F.timestamp_seconds("at"))


def pending(spark: SparkSession, folder: str) -> DataFrame:
    """Array files that carry no mark of having been processed."""
    return listing(spark, folder).where(~F.startswith("name", F.lit(PROCESSED)))


def latest_path(runs: list[Run]) -> str | None:
    """The name of the newest run; None without runs."""
    return runs[-1].name if runs else None


def read_run(spark: SparkSession, runs: str | Run | list[str | Run], schema: str = RUN_NOTICE) -> DataFrame:
    """Rows of runs, (schema, _corrupt_record, path, run); a path stands for an array file.

    _corrupt_record holds what is no JSON, file and bad rows apart from the good.
    """
    runs = [Run(r, 0, (r,), True, 1, 1) if isinstance(r, str) else r for r in (runs if isinstance(runs, list) else [runs])]
    found = []
    for arrays in (True, False):
        paths = {p: r.name for r in runs if r.arrays == arrays and r.length for p in r.paths}
        if paths:
            reader = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", arrays).option("mode", "PERMISSIVE").option("encoding", "UTF-8").option("recursiveFileLookup", True)
            rows = reader.json(list(paths))
            rows = rows.select(*rows.columns, F.col("_metadata.file_path").alias("path"))
            # a run's files as rows name them, and its name: as many rows as there are files or folders
            names = spark.createDataFrame([(_as_read(spark, p), name) for p, name in paths.items()], "place string, run string")
            place = F.regexp_replace("path", "^file:/+", "file:/")
            found.append(rows.withColumn("place", place if arrays else F.regexp_extract(place, "^(.*)/[^/]*$", 1)).join(names, "place").drop("place"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"{schema}, _corrupt_record string, path string, run string")


def read_runs(spark: SparkSession, folder: str, schema: str = RUN_NOTICE) -> DataFrame:
    """Rows of all runs of a folder with ``at``, the time of their run."""
    runs = run_list(spark, folder)
    at = spark.createDataFrame([(r.name, r.at / 1000) for r in runs], "run string, at double").withColumn("at", F.timestamp_seconds("at"))
    return read_run(spark, runs, schema).join(at, "run")


def _as_read(spark: SparkSession, path: str) -> str:
    """A path as rows name it: with odd characters escaped, a local one with a single slash in front."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toUri().toString()
    return re.sub("^file:/+", "file:/", whole)


def latest_run(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the newest run, none if that run has none; no runs give no rows."""
    return read_run(spark, run_list(spark, folder)[-1:]).where("id is not null").drop("_corrupt_record", "path", "run")


def latest_with_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the newest run that has any, for readers to whom a run without rows says nothing."""
    for run in reversed(run_list(spark, folder)):
        rows = read_run(spark, run).where("id is not null").drop("_corrupt_record", "path", "run")
        if run.length and not rows.isEmpty():
            return rows
    return read_run(spark, []).drop("_corrupt_record", "path", "run")


def latest_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """Each id's row of the newest run that has it, whatever later runs lack; of several in one run the largest."""
    newest = F.max_by(F.struct("date", "message"), F.struct("at", "run", "date", "message"))
    rows = read_runs(spark, folder).where("id is not null")
    return rows.groupBy("id").agg(newest.alias("n")).select("id", "n.date", "n.message")


def status(spark: SparkSession, folder: str) -> DataFrame:
    """One row: runs on record, those without rows too, the time of the last, the largest id in any."""
    last = read_runs(spark, folder).agg(F.max("id").alias("last_id"))
    return recorded(spark, folder).agg(F.count("*").alias("total_runs"), F.max("at").alias("last_run")).withColumn("last_id", last.scalar())


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """(id, raw_json) of per-notice result files named result_<id>.json."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "result_*.json").load(folder)
    ident = F.regexp_extract("path", r"result_([0-9]+)\.json$", 1).try_cast("long")
    return files.select(ident.alias("id"), F.decode("content", "UTF-8").alias("raw_json")).where("id is not null")


def write_run(rows: DataFrame, folder: str, run_id: str, at_ms: int | None = None) -> None:
    """One run as JSON lines under its id, in as many files as it has parts; writing it again replaces it, and readers meet the old run until the new one is whole.

    A run without rows is on record.  ``at_ms`` is when it was made, by default when it is committed.
    """
    log = _log(spark := rows.sparkSession, folder)
    new = log.written(rows, run_id)
    files = _files(spark, log.paths([new])[0])
    entry = type(new)(new.folder, run_id, new.rows, 0, 0, {"n_files": len(files), "length": sum(size for *_, size in files), "at": at_ms})
    log.commit(lambda now: ([entry], [e.folder for e in now.of(run_id)]))


def write_results(results: DataFrame, path: str) -> None:
    """Raw extraction results (id, raw_json, model, prompt_hash) as Parquet."""
    results.select("id", "raw_json", "model", "prompt_hash").write.mode("append").parquet(path)
