"""The two ingestion flows and the read path, as plans over DataFrames.

Every filter stands before the Python stage that it spares, since no optimiser
moves one past it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.functions import html as H
from noticelake.functions import text as T
from noticelake.operators import addresses as A
from noticelake.operators import extract as E
from noticelake.operators import incremental as I
from noticelake.schemas import NOTICE_DEFAULTS, TRANSIT_EXTRACTION, WATER_EXTRACTION
from noticelake.sources.pages import Fetcher, fetch_pages
from noticelake.store import written


@dataclass
class Ingested:
    """What a flow makes of a batch: the records, the rows set aside with their error, and the new state."""

    records: DataFrame
    quarantined: DataFrame
    state: DataFrame


def new_transit_notices(pages: DataFrame, seen: DataFrame, html_col: str = "html", dedup: bool = False, hash_missing_ids: bool = True) -> DataFrame:
    """Notices of transit pages that were not seen yet."""
    notices = pages.select(F.inline(H.transit_notices(html_col)))
    if hash_missing_ids:
        notices = I.with_fallback_id(notices, "data_id", NOTICE_DEFAULTS["data_id"], ["header", "body"])
    return I.unseen(notices, seen, "data_id", dedup=dedup)


def transit(pages: DataFrame, seen: DataFrame, extractor: E.Extractor | None = None, system: str = "", **options) -> Ingested:
    """Transit pages to records of new notices; without an extractor the bus lines come by rule, in the JVM."""
    fresh = written(new_transit_notices(pages, seen, **options), "fresh")
    ids = fresh.select("data_id")
    if extractor is None:
        ruled = fresh.withColumn("parsed", F.struct(T.bus_lines(T.prompt("header", "body")).alias("bus_lines")))
        return Ingested(E.transit_records(ruled), fresh.limit(0), ids)
    asked = fresh.withColumn("text", T.prompt("header", "body"))
    raw = written(E.extract(asked, extractor, system, "text", ["data_id", "header", "body", "info_time"]), "answers")
    good, bad = E.parsed(raw, TRANSIT_EXTRACTION)
    return Ingested(E.transit_records(good), bad, ids)


def new_water_links(listings: DataFrame, stored: int, html_col: str = "html") -> DataFrame:
    """(url, message_id) of links above the watermark; links without an id are skipped."""
    links = listings.select(F.explode(H.listing_links(html_col)).alias("url")).withColumn("message_id", T.url_id("url"))
    return I.above_watermark(links, "message_id", stored)


def water(listings: DataFrame, stored: int, fetch: Fetcher, extractor: E.Extractor = E.rule_extractor, system: str = "", gazetteer: DataFrame | None = None, delay_s: float = 0.0, strict_reference: bool = False) -> Ingested:
    """Listing pages to addresses of new water notices, with coordinates where the gazetteer has them.

    The state is the largest id of the listing, whether or not its page could
    be read; pages that failed are in the quarantine with their URL, for
    :func:`retried`.  With ``strict_reference`` they are lost, as the mark has
    passed them, and so are pages without a title.
    """
    links = written(new_water_links(listings, stored).distinct(), "links")
    found = _water_pages(links, fetch, extractor, system, gazetteer, delay_s, strict_reference)
    return Ingested(found.records, found.quarantined, I.advanced(links, "message_id", stored))


def retried(quarantined: DataFrame, fetch: Fetcher, extractor: E.Extractor = E.rule_extractor, system: str = "", gazetteer: DataFrame | None = None, delay_s: float = 0.0) -> Ingested:
    """Quarantined water pages once more, each URL once: what can be read now, and what stays in quarantine; the state is as it was."""
    links = written(quarantined.select("url", "message_id").distinct(), "links")
    found = _water_pages(links, fetch, extractor, system, gazetteer, delay_s, False)
    return Ingested(found.records, found.quarantined, links.select(F.col("message_id").alias("last_id")).limit(0))


def _water_pages(links: DataFrame, fetch: Fetcher, extractor: E.Extractor, system: str, gazetteer: DataFrame | None, delay_s: float, strict_reference: bool) -> Ingested:
    """Each page is fetched once and each text asked once: both are written before anything reads them.

    A page without a title is judged by its content alone.
    """
    fetched = written(fetch_pages(links, fetch, delay_s=delay_s, keep=("message_id",)), "pages")
    detail = fetched.where("error is null").select("url", "message_id", H.water_detail("html").alias("page"))
    told = detail.where("page is not null").select("url", "message_id", "page.date", F.concat_ws("\n", "page.title", "page.content").alias("text"), F.col("page.title").isNull().alias("untitled"))
    raw = written(E.extract(told.where("not untitled") if strict_reference else told, extractor, system, "text", ["url", "message_id", "date"]), "answers")
    good, bad = E.parsed(raw, WATER_EXTRACTION)
    times = [f"parsed.{c}" for c in ("start_time", "start_date", "end_time", "end_date")]
    rows = good.select("message_id", "date", *times, F.col("parsed.locations").alias("locations"))
    records = A.flattened(rows, keep=["message_id", "date", "start_time", "start_date", "end_time", "end_date"])
    if gazetteer is not None:
        records = A.geocoded(records, gazetteer)
    lost = fetched.where("error is not null").select("url", "message_id", "error")
    empty = detail.where("page is null").select("url", "message_id", F.lit("no content").alias("error"))
    refused = bad.select("url", "message_id", F.coalesce("error", F.lit("malformed JSON")).alias("error"))
    return Ingested(records, refused if strict_reference else lost.unionByName(empty).unionByName(refused), links)
