"""Page fetching through an injected function, one batch of URLs at a time in tasks."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.schemas import FETCHED

Fetcher = Callable[[str], str]
TIMEOUT_S = 10
#: How the error of a page that does not exist begins.
MISSING = "PageMissing"


class PageMissing(LookupError):
    """There is no page at this address; asking again is no use."""


def http_fetcher(timeout: float = TIMEOUT_S, headers: dict[str, str] | None = None) -> Fetcher:
    """Fetches by HTTP; a status of 404 or 410 raises :class:`PageMissing`, any other that is no success what it is."""

    def fetch(url: str) -> str:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as response:
                return response.read().decode(response.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                raise PageMissing(url) from e
            raise

    return fetch


class _Pace:
    """A task's share of a budget of requests: one token every so many seconds, none saved up."""

    def __init__(self, seconds: float):
        self.seconds, self.next = seconds, 0.0

    def wait(self) -> None:
        if self.seconds:
            now = time.monotonic()
            if self.next > now:
                time.sleep(self.next - now)
            self.next = max(now, self.next) + self.seconds


def fetch_pages(urls: DataFrame, fetch: Fetcher, url_col: str = "url", delay_s: float = 0.0, keep: tuple[str, ...] = (), rate_per_s: float | None = None, tasks: int = 4, retries: int = 0, backoff_s: float = 1.0) -> DataFrame:
    """(url, html, error) of each row's page behind the columns to keep, in place; a failure is an error text and no exception.

    What reads the result twice fetches twice: write it first.

    ``rate_per_s`` is what the whole job may ask for: the rows are dealt to ``tasks`` tasks, each
    of which has its part of the budget, however many of them run at a time.  A failed
    request is made again up to ``retries`` times, after ``backoff_s`` seconds and twice as
    long each further time, and draws on the budget like any other; a page that does not
    exist is asked for once.

    With a delay instead the rows go through one task, which pauses between
    requests; it is meant for a listing's few new links.
    """

    def attempt(url: str, pace: _Pace) -> tuple[str, str | None, str | None]:
        for k in range(retries + 1):
            pace.wait()
            try:
                return url, fetch(url), None
            except Exception as e:  # noqa: BLE001
                # by name: a fetcher's classes need not be those of the worker
                missing = any(c.__name__ == MISSING for c in type(e).__mro__)
                if k == retries or missing:
                    return url, None, f"{MISSING if missing else type(e).__name__}: {e}"
                time.sleep(backoff_s * 2**k)
        raise AssertionError

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = _Pace(tasks / rate_per_s if rate_per_s else delay_s)
        for batch in batches:
            out = [attempt(url, pace) for url in batch["url"]]
            found = pd.DataFrame(out, columns=["url", "html", "error"], index=batch.index)
            yield pd.concat([batch[list(keep)], found], axis=1)

    rows = urls.select(*keep, F.col(url_col).alias("url"))
    kept = "".join(f"`{c}` {urls.schema[c].dataType.simpleString()}, " for c in keep)
    dealt = rows.repartition(tasks) if rate_per_s else rows.coalesce(1) if delay_s else rows
    return dealt.mapInPandas(run, kept + FETCHED)


class SourceUnavailable(RuntimeError):
    """A listing page could not be fetched."""


def read_listing(spark: SparkSession, url: str, fetch: Fetcher, fail_on_error: bool = True) -> DataFrame:
    """The listing page as one row (url, html, error); by default a failure ends the run."""
    try:
        row = (url, fetch(url), None)
    except Exception as e:
        if fail_on_error:
            raise SourceUnavailable(url) from e
        row = (url, None, f"{type(e).__name__}: {e}")
    return spark.createDataFrame([row], FETCHED)


def read_users(spark: SparkSession, path: str | None = None, **jdbc: str) -> DataFrame:
    """The user table, from Parquet or, given its options, by JDBC."""
    return spark.read.parquet(path) if path else spark.read.format("jdbc").options(**jdbc).load()
