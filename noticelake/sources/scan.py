"""A scan of consecutive ids that nobody lists: pages are fetched upward until several in a row are missing.

Ids are fetched in waves, each twice as large as the one before, by as many tasks as there
are.  Which of a wave's pages the scan would have met one by one is decided from the
wave and from the last hit before it, so that a stop across two waves is found too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import text as T
from noticelake.operators import incremental as I
from noticelake.sources.pages import MISSING, Fetcher, fetch_pages
from noticelake.store import written

#: (id) to (id, url, html, error), one row an id.
Wave = Callable[[DataFrame], DataFrame]


@dataclass
class Scanned:
    """The pages (id, url, html) that were met before the stop, the last id among them (None without any), the id that could not be
    read and so ended the scan (None where misses ended it), and how many ids were fetched in how many waves."""

    pages: DataFrame
    last_id: int | None
    failed_id: int | None
    fetched: int
    waves: int


def by_fetcher(prefix: str, fetch: Fetcher, **options) -> Wave:
    """Waves through a fetcher; an id's address is ``prefix``, the id and .html.  Options are those of ``fetch_pages``."""
    return lambda ids: fetch_pages(ids.select("id", T.message_url(prefix, "id").alias("url")), fetch, keep=("id",), **options)


def scan_ids(spark: SparkSession, start: int, wave: Wave, misses: int = 3, is_hit: Column | None = None, most: int = 1 << 16) -> Scanned:
    """Fetches ids from ``start`` upward until ``misses`` in a row are missing.

    An id is missing if its page does not exist or is none by ``is_hit`` (over id, url, html; default: there is html).
    Any other error ends the scan before that id, as what lies behind it cannot be judged; the
    next scan starts there again.  Waves begin with ``misses`` ids and double up to ``most``, so
    fewer than twice the ids that are needed are fetched, and ``misses`` more.  Of each wave the driver
    sees three numbers.
    """
    hit = F.col("html").isNotNull() if is_hit is None else is_hit
    at, size, last, found, fetched = start, misses, start - 1, [], 0
    while True:
        ids = spark.range(at, at + size, 1, min(size, spark.sparkContext.defaultParallelism))
        pages = written(wave(ids), "wave")
        missing = F.startswith("error", F.lit(MISSING))
        told = pages.select("id", "url", "html", (F.col("error").isNull() & F.coalesce(hit, F.lit(False))).alias("hit"), (F.col("error").isNotNull() & ~missing).alias("failed"))
        hits, fetched = told.where("hit"), fetched + size
        at += size
        failed = told.where("failed").agg(F.min("id")).first()[0]
        before = I.last_valid(hits, last + 1, misses).first().last_id
        end = last if before is None else before
        stopped = end + misses < at  # otherwise the misses behind it may go on in the next wave
        if failed is not None and (not stopped or failed <= end + misses):
            met = hits.where(F.col("id") < failed)
        else:
            failed, met = None, hits.where(F.col("id") <= end)
        found.append(met.select("id", "url", "html"))
        if stopped or failed is not None:
            whole = reduce(DataFrame.unionByName, found)
            return Scanned(whole, whole.agg(F.max("id")).first()[0], failed, fetched, len(found))
        last, size = end, min(2 * size, most)
