"""Scans of ids in waves, and budgets of requests."""

import random
import time

import pytest

from noticelake.sources import pages, scan
from tests.test_incremental import loop


def fetcher(ids, failing=(), calls=None):
    class PageMissing(LookupError):
        pass

    def fetch(url):
        ident = int(url.removeprefix("/").removesuffix(".html"))
        if calls is not None:
            calls.add(1)
        if ident in failing:
            raise OSError("down")
        if ident not in ids:
            raise PageMissing(url)
        return f"page {ident}"

    return fetch


@pytest.mark.parametrize("misses", [1, 3])
def test_against_one_id_at_a_time(spark, misses):
    rng = random.Random(misses)
    for ids in [set(), set(range(5, 30)), {5, 6, 8, 11, 15}, {rng.randrange(5, 60) for _ in range(50)}]:
        calls = spark.sparkContext.accumulator(0)
        got = scan.scan_ids(spark, 5, scan.by_fetcher("/", fetcher(ids, calls=calls)), misses)
        want = loop(ids, 5, misses)
        assert sorted(r.id for r in got.pages.collect()) == want and got.last_id == max(want, default=None) and got.failed_id is None
        needed = max([*want, 4]) - 4 + misses
        assert calls.value == got.fetched < 2 * needed + misses


def test_a_failure_ends_the_scan_before_it(spark):
    ids = set(range(1, 40))
    got = scan.scan_ids(spark, 1, scan.by_fetcher("/", fetcher(ids, failing={20, 25})))
    assert sorted(r.id for r in got.pages.collect()) == list(range(1, 20)) and (got.last_id, got.failed_id) == (19, 20)
    again = scan.scan_ids(spark, got.failed_id, scan.by_fetcher("/", fetcher(ids)))
    assert sorted(r.id for r in again.pages.collect()) == list(range(20, 40)) and again.failed_id is None
    beyond = scan.scan_ids(spark, 1, scan.by_fetcher("/", fetcher({1, 2}, failing={7, 8})))  # behind the stop nothing matters
    assert (beyond.last_id, beyond.failed_id) == (2, None)


def test_pages_without_content_are_misses(spark):
    from pyspark.sql import functions as F

    got = scan.scan_ids(spark, 1, scan.by_fetcher("/", lambda url: "x" if url < "/4" else "", retries=1), is_hit=F.col("html") != "")
    assert got.last_id == 3 and got.pages.orderBy("id").first().url == "/1.html"


def test_retries_and_back_off(spark, tmp_path):
    """Each attempt leaves a file: the second succeeds, a missing page is asked for once."""
    folder = str(tmp_path)

    class PageMissing(LookupError):
        pass

    def fetch(url):
        import os
        import uuid

        open(f"{folder}/{url}.{uuid.uuid4().hex}", "w").close()
        n = sum(f.startswith(url) for f in os.listdir(folder))
        if url == "gone":
            raise PageMissing(url)
        if n < 2 or url == "never":
            raise OSError("down")
        return "ok"

    urls = spark.createDataFrame([("late",), ("gone",), ("never",)], "url string")
    got = {r.url: (r.html, r.error) for r in pages.fetch_pages(urls, fetch, retries=2, backoff_s=0.01).collect()}
    assert got == {"late": ("ok", None), "gone": (None, "PageMissing: gone"), "never": (None, "OSError: down")}
    names = [f.name.split(".")[0] for f in tmp_path.iterdir()]
    assert (names.count("late"), names.count("gone"), names.count("never")) == (2, 1, 3)


def test_four_tasks_keep_the_rate_of_the_job(spark):
    urls = spark.range(120).selectExpr("cast(id as string) as url")
    for _ in range(2):  # the first run starts the workers
        got = pages.fetch_pages(urls, lambda url: repr(time.time()), rate_per_s=40, tasks=4).collect()
    times = sorted(float(r.html) for r in got)
    rate = (len(times) - 4) / (times[-1] - times[0])  # four tokens are there at once
    assert 36 <= rate <= 44, rate
    assert pages.fetch_pages(urls, str, rate_per_s=40, tasks=4).rdd.getNumPartitions() == 4
