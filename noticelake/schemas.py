"""Schemas of notices, extractions, users and state, as DDL strings."""

from __future__ import annotations

#: A notice of a transit page; missing fields hold the text in ``NOTICE_DEFAULTS``.
TRANSIT_NOTICE = "data_id string, header string, body string, info_time string"
NOTICE_DEFAULTS = {"data_id": "No ID", "header": "No header", "body": "No body", "info_time": "No time"}
TRANSIT_EXTRACTION = "bus_lines array<string>"
TRANSIT_RECORD = f"id string, original_message struct<{TRANSIT_NOTICE.replace(' string', ':string')}>, bus_lines array<string>"
#: The detail page of a water notice; null where the page has no content.
WATER_PAGE = "title string, date string, content string"
WATER_EXTRACTION = (
    "locations array<struct<location_name:string, sublocations:array<struct<sublocation_name:string, streets:array<string>>>>>, "
    "start_time string, start_date string, end_time string, end_date string"
)
#: A notice of a recorded run, its flat extraction, and what is served of both.
RUN_NOTICE = "id long, date string, message string"
FLAT_EXTRACTION = "locations array<string>, start_time string, end_time string"
OUTAGE = f"{RUN_NOTICE}, {FLAT_EXTRACTION}, lat double, lng double"
ADDRESS = "struct<street:string, neighborhood:string>"
USER = f"email string, first_name string, last_name string, addresses array<{ADDRESS}>"
ACCOUNT = "user_id string, email string, latitude decimal(9,6), longitude decimal(9,6), created timestamp, updated timestamp"
SETTINGS = "email string, frequency string, quiet_start string, quiet_end string, refresh_minutes int"
#: State tables.
WATERMARK = "last_id long"
SEEN_IDS = "data_id string, batch_id long"
FETCHED = "url string, html string, error string"
PROMPT = "array<struct<role:string, content:string>>"
