"""What a service on top calls, by the names of its endpoints; every function returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticelake.operators import serve, users
from noticelake.sources import runs
from noticelake.sources.lookup import KeyedTable
from noticelake.streaming.ingest import ingest_above, ingest_unseen

__all__ = ["current_outages", "ingest_above", "ingest_unseen", "near_me", "outage_by_id", "outages_by_id", "run_status", "search_outages", "user_by_email", "users_delete", "users_register", "users_set_addresses", "users_upsert"]


def current_outages(spark: SparkSession, folder: str, parsed: DataFrame, newest_run_only: bool = True) -> DataFrame:
    """The served outages of the newest run, or of each id's newest run that has it."""
    notices = runs.latest_run(spark, folder) if newest_run_only else runs.latest_by_id(spark, folder)
    return serve.current_outages(notices, parsed)


def outage_by_id(outages: DataFrame, ident: int) -> DataFrame:
    """The outage of an id; no row where there is none."""
    return serve.by_id(outages, ident)


def outages_by_id(outages: DataFrame, path: str) -> KeyedTable:
    """Served outages as a table whose ``get`` and ``get_many`` open only files that can hold an id; for services that are asked often."""
    return KeyedTable.of(outages, path, "id")


def run_status(spark: SparkSession, folder: str) -> DataFrame:
    """One row: runs on record, the time of the last, the largest id in any."""
    return runs.status(spark, folder)


search_outages = serve.search
near_me = serve.near
user_by_email = users.by_email
users_register = users.registered
users_upsert = users.upserted
users_delete = users.deleted
users_set_addresses = users.with_addresses
