"""What is new: high-water marks, seen ids, and scans that stop after misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def above_watermark(rows: DataFrame, id_col: str, stored: int) -> DataFrame:
    """Rows with an id above the stored one; rows without an id are skipped."""
    return rows.where(F.col(id_col) > F.lit(stored))


def advanced(rows: DataFrame, id_col: str, stored: int) -> DataFrame:
    """One row (last_id): the largest id, at least the stored one."""
    return rows.agg(F.greatest(F.lit(stored).cast("long"), F.coalesce(F.max(id_col).cast("long"), F.lit(stored))).alias("last_id"))


def next_id(state: DataFrame, first: int = 16_000) -> DataFrame:
    """One row (next_id): behind the stored id, or the first without state."""
    return state.agg(F.coalesce(F.max("last_id") + 1, F.lit(first)).cast("long").alias("next_id"))


def matching(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column holds the pattern."""
    return rows.where(F.col(column).rlike(pattern))


def unseen(rows: DataFrame, seen: DataFrame, on: str, seen_col: str | None = None, dedup: bool = False) -> DataFrame:
    """Rows whose id is not among the seen ones.

    Rows that share an id within the batch all stay, unless ``dedup`` is set.
    Rows without an id are never seen.  The optimiser broadcasts the seen ids
    while they are small and shuffles both sides when they are not.
    """
    ids = seen.select(F.col(seen_col or on).alias(on)).distinct()
    fresh = rows.join(ids, on, "left_anti")
    return fresh.dropDuplicates([on]) if dedup else fresh


def with_fallback_id(rows: DataFrame, id_col: str, missing: str, parts: list[str]) -> DataFrame:
    """A hash of the parts in place of an id that is missing, so that such rows differ from each other."""
    return rows.withColumn(id_col, F.when(F.col(id_col).isNull() | (F.col(id_col) == missing), F.sha2(F.concat_ws("\n", *parts), 256)).otherwise(F.col(id_col)))


def is_valid(*columns: str) -> Column:
    """All of the columns are there and not empty."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.col(c) != "", F.lit(False))
    return out


def until_misses(hits: DataFrame, start: int | None = None, misses: int = 3, id_col: str = "id") -> DataFrame:
    """The hits that a scan of consecutive ids meets before it stops.

    ``hits`` holds the valid ids; an id that it lacks is a miss.  The scan goes
    up from ``start`` (default: the smallest hit) and stops at the ``misses``-th
    miss in a row.  A hit is the last one exactly if none of the next ids is a
    hit, so the stop is the least such hit: two equality joins and a minimum,
    and no window over all ids.
    """
    ids = hits.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    before = [] if start is None else [start - 1]
    if before:
        ids = ids.where(F.col("id") >= start)
        origin = ids.sparkSession.range(start - 1, start)
        candidates = ids.unionByName(origin)
    else:
        candidates = ids
    follow = ids.select(F.explode(F.array(*(F.col("id") - k for k in range(1, misses + 1)))).alias("id")).distinct()
    last = candidates.join(follow, "id", "left_anti").agg(F.min("id").alias("last"))
    met = hits.where(F.col(id_col).cast("long") <= last.scalar())
    return met.where(F.col(id_col) >= start) if before else met


def last_valid(hits: DataFrame, start: int | None = None, misses: int = 3, id_col: str = "id") -> DataFrame:
    """One row (last_id): the last hit before the stop, null if there is none."""
    return until_misses(hits, start, misses, id_col).agg(F.max(id_col).cast("long").alias("last_id"))


def appended(seen: DataFrame, new: DataFrame) -> DataFrame:
    """Seen ids and new ones, repeats kept as in a list."""
    return seen.unionByName(new)
