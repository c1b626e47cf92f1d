"""Structured records from free text through an injected extractor, with a quarantine for what fails."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import text as T

#: (system prompt, text) to JSON text.
Extractor = Callable[[str, str], str]


def extract(rows: DataFrame, extractor: Extractor, system: str, text_col: str, keep: list[str]) -> DataFrame:
    """The columns to keep, raw_json and error; filter before this, no filter moves past it.

    A null text is an error and never reaches the extractor.  What reads the
    result twice asks twice: write it first.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw, errors = [], []
            for value in batch.iloc[:, -1]:
                try:
                    if value is None:
                        raise ValueError("no text")
                    raw.append(extractor(system, value))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    raw.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch[keep].assign(raw_json=raw, error=errors)

    return rows.select(*keep, F.col(text_col).alias("__text")).mapInPandas(run, f"{kinds}, raw_json string, error string")


def unwrapped(raw: Column | str) -> Column:
    """JSON text out of a JSON string that holds it; anything else as it is."""

    def text(r: Column) -> Column:
        held = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(r)
        return T.bound(F.try_parse_json(r), held)

    return T.bound(raw, text)


def _variant(raw: Column) -> Column:
    """The variant of a JSON text, or of the one in a JSON string: one parse for a text, a second for what a string holds."""
    inner = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v)
    return T.bound(F.try_parse_json(raw), inner)


def parsed(rows: DataFrame, schema: str, raw_col: str = "raw_json", into: str = "parsed", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): rows with a typed struct, and those whose JSON is missing or malformed.

    Unknown keys fall away; absent and null keys are both null, and so are values
    that are not of the wanted type and cannot be cast.  ``strict`` raises at the first malformed row instead.

    Each half parses a text once: a row goes on as one element of an array or as none, since
    the test of a filter would be made again where its column is used.
    """
    if strict:
        return rows.withColumn(into, F.from_json(unwrapped(raw_col), schema, {"mode": "FAILFAST"})), rows.limit(0)
    whole = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    told = F.array(F.struct(_variant(F.col(raw_col)).alias("__variant")))
    good = rows.select("*", F.inline(F.filter(told, lambda s: whole(s["__variant"]))))
    good = good.withColumn(into, F.try_variant_get("__variant", "$", _struct(rows.sparkSession, schema))).drop("__variant")
    bad = rows.select("*", F.inline(F.filter(told, lambda s: ~whole(s["__variant"])))).drop("__variant")
    return good, bad


def _struct(spark: SparkSession, schema: str) -> str:
    """The struct type of a table schema."""
    return spark.createDataFrame([], schema).schema.simpleString()


def transit_records(good: DataFrame) -> DataFrame:
    """Records (id, original_message, bus_lines); the id is random, so write them before using them twice."""
    message = F.struct("data_id", "header", "body", "info_time")
    return good.select(F.expr("uuid()").alias("id"), message.alias("original_message"), F.col("parsed.bus_lines").alias("bus_lines"))


#: Words before the name of a town (left out), a district (kept), a street (left out or kept) and a block.
TOWN_WORDS = ("с.", "гр.")
DISTRICT_WORDS = ("ж.к.", "кв.", "м-т")
STREET_WORDS = {"ул.": "", "бул.": "бул. "}
BLOCK_WORD = "бл."
DEFAULT_CITY = "Варна"
_NAME = r"\s*[\"„“]?\s*([А-Я][А-Яа-я.\- ]*?[А-Яа-я])\s*[\"“”]?(?=[\s,.;]|$)"
_DATE = re.compile(r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}")


def _named(word: str, message: str) -> list[str]:
    return re.findall(r"(?<![А-Яа-я])" + re.escape(word) + _NAME, message)


def _clock_after(word: str, message: str) -> str | None:
    """HH:MM of the first time of day behind a word, as hour alone or with minutes."""
    found = re.search(rf"(?i)(?<!\w){word}\s*(?:около\s*)?([0-9]{{1,2}}+)(?:\s*[.,:]\s*([0-9]{{2}})(?![.0-9]))?+(?!\.?[0-9]|-)\s*ч?", _DATE.sub(" ", message))
    minutes = found and int(found[1]) * 60 + int(found[2] or 0)
    return None if minutes is None or minutes > 1440 or int(found[2] or 0) > 59 else f"{minutes // 60:02d}:{minutes % 60:02d}"


def rule_extractor(system: str, message: str) -> str:
    """A deterministic stand-in for a language model: towns, districts, streets, times and dates by rule."""
    towns = [n for w in TOWN_WORDS for n in _named(w, message)] or [DEFAULT_CITY]
    inner = [f"{word} {name}" for word in DISTRICT_WORDS for name in _named(word, message)]
    streets = [kept + name for word, kept in STREET_WORDS.items() for name in _named(word, message)]
    block = re.search(re.escape(BLOCK_WORD) + r"\s*([0-9]+)", message)
    if block:
        streets = [f"{BLOCK_WORD} {block[1]}, {s}" for s in streets]
    subs = [{"sublocation_name": x, "streets": streets} for x in inner] or ([{"sublocation_name": None, "streets": streets}] if streets else [])
    places = [{"location_name": t.strip(), "sublocations": subs if k == 0 else []} for k, t in enumerate(towns)]
    dates = [*_DATE.findall(message), None, None]
    times = {"start_time": _clock_after("от", message), "start_date": dates[0], "end_time": _clock_after("до", message), "end_date": dates[1]}
    return json.dumps({"locations": places, **times}, ensure_ascii=False)


def flat_extraction(message: Column | str) -> Column:
    """struct<locations, start_time, end_time> of a notice, all in the JVM, each expression over its text once."""
    return T.bound(message, _flat)


def _flat(message: Column) -> Column:
    names = F.regexp_extract_all(message, F.lit(r"(?:(?<![\p{L}])(?:с|гр|кв|ул|бул|ж\.к)\.\s*)[\"„“]?\s*([\p{Lu}][\p{L}.\- ]*?\p{L})(?=[\"“”,;]|\.?\s|\.?$)"), F.lit(1))
    places = F.array_distinct(names).alias("locations")
    return T.bound(T.time_range(message), lambda span: F.struct(places, T.clock(span["start_minute"]).alias("start_time"), T.clock(span["end_minute"]).alias("end_time")))


def usable_batches(files: DataFrame, content_col: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(usable, empty, malformed) of files with the text of JSON arrays; nothing is deleted."""
    text = T.strip(F.col(content_col))
    kind = F.schema_of_variant(F.try_parse_json(text))
    blank = F.coalesce(text == "", F.lit(True)) | F.coalesce(F.regexp_replace(text, r"\s", "") == "[]", F.lit(False))
    told = files.withColumn("__kind", F.when(blank, "empty").when(kind.isNull(), "malformed").otherwise("usable"))
    return tuple(told.where(F.col("__kind") == k).drop("__kind") for k in ("usable", "empty", "malformed"))
