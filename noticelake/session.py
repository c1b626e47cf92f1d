"""The session that the library is meant to run in."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(app_name: str = "noticelake", master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; further settings win."""
    builder = SparkSession.builder.appName(app_name).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
