"""Answers of slow services that are kept: a question that was answered once is never asked again.

A question is the values of some columns, its name the hash of these.  Before a service is asked,
distinct questions of a batch are compared with what is on record; only the rest goes out,
each once, and its answers are added by one commit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.operators import extract as E
from noticelake.sources.commits import CommitLog
from noticelake.sources.pages import _Pace
from noticelake.store import written

ANSWER = "raw_json string, model string"
PLACE = "lat double, lng double"
#: An address to (latitude, longitude), or None where it is not known.
Lookup = Callable[[str], tuple[float, float] | None]


class Memo:
    """What is on record below a path: the hash of a question and the columns of its answer."""

    def __init__(self, spark: SparkSession, path: str, answer: str):
        self.log, self.schema = CommitLog(spark, path), f"question string, {answer}"
        self.answer = [c for c in spark.createDataFrame([], answer).columns]

    def read(self) -> DataFrame:
        """One answer to each question; if two writers asked at the same time, the least."""
        least = F.min(F.struct(*self.answer)).alias("a")
        return self.log.read(self.schema).groupBy("question").agg(least).select("question", "a.*")

    def answered(self, rows: DataFrame, about: list[str], ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``rows`` with the columns of the answer and ``error``.

        ``ask`` gets (question, the columns ``about``) of new questions, each once, and returns question, the
        answer and error.  Answers without an error are kept, also those that say that nothing is known;
        failures are not, and are asked again next time.
        """
        parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in about]
        keyed = rows.withColumn("__question", F.sha2(F.to_json(F.array(*parts)), 256))
        distinct = keyed.select(F.col("__question").alias("question"), *(F.col(f"`{c}`") for c in about)).dropDuplicates(["question"])
        known = written(self.read(), "answers")
        new = written(distinct.join(known.select("question"), "question", "left_anti"), "questions")
        columns = ["question", *self.answer]
        asked = written(ask(new).select(*columns, "error"), "asked")
        fresh = asked.where("error is null").select(*columns)
        if not fresh.isEmpty():
            self.log.append(fresh, "answers")
        every = known.withColumn("error", F.lit(None).cast("string")).unionByName(asked)
        return keyed.join(every.withColumnRenamed("question", "__question"), "__question", "left").drop("__question")


def extract_once(rows: DataFrame, extractor: E.Extractor, system: str, text_col: str, memo: Memo, model: str = "") -> DataFrame:
    """``rows`` with raw_json, model and error; a text that this model and prompt have answered is not sent again, whichever batch it is in."""

    def ask(new: DataFrame) -> DataFrame:
        told = E.extract(new, extractor, system, text_col, ["question"])
        return told.select("question", "raw_json", F.lit(model).alias("model"), "error")

    return memo.answered(rows.withColumns({"__system": F.lit(system), "__model": F.lit(model)}), ["__system", "__model", text_col], ask).drop("__system", "__model")


def geocode_once(addresses: DataFrame, lookup: Lookup, memo: Memo, address_col: str = "address", rate_per_s: float | None = None, tasks: int = 1) -> DataFrame:
    """``addresses`` with lat, lng and error; each distinct address is looked up once, also one that is not found.

    Upper and lower case and outer white space make no difference.  ``rate_per_s`` is what the whole job
    may ask for, dealt to ``tasks`` tasks.  A null address is not looked up.
    """

    def ask(new: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pace = _Pace(tasks / rate_per_s if rate_per_s else 0.0)
            for batch in batches:
                out = []
                for question, address in zip(batch["question"], batch["__address"], strict=True):
                    found, error = None, None
                    if address is not None:
                        pace.wait()
                        try:
                            found = lookup(address)
                        except Exception as e:  # noqa: BLE001
                            error = f"{type(e).__name__}: {e}"
                    out.append((question, *(found or (None, None)), error))
                yield pd.DataFrame(out, columns=["question", "lat", "lng", "error"])

        dealt = new.repartition(tasks) if rate_per_s else new
        return dealt.mapInPandas(run, f"question string, {PLACE}, error string")

    folded = F.lower(F.trim(F.col(f"`{address_col}`")))
    return memo.answered(addresses.withColumn("__address", folded), ["__address"], ask).drop("__address")
