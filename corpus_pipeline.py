"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm import decontam, linededup, packing, qualityrules, simhash
from noticelake.llm.common import table, written
from noticelake.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or the learned decision list; each row by its own text, whatever its id.

    Null and empty texts fail the base; repeated rows stay or go alike; without labels only the base rules reject.
    """
    return qualityrules.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share, but for those of the largest doc_id; n_chars follows a text that lost some.

    A null text becomes the empty one.  Rows that repeat an id each count and keep or lose alike, rows without an id
    count and lose nothing.
    """
    own = {c: f"__c{i}" for i, c in enumerate(docs.columns)}  # whatever other columns are called, they come back as they were
    kept = linededup.drop_repeated_lines(docs.toDF(*own.values()), id_col=own["doc_id"], text_col=own["text"])
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length(own["text"])).otherwise(F.col(own["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn(own["n_chars"], n_chars).select(*(F.col(s).alias(c) for c, s in own.items()))


KEY, ORDER = "__row_key", "__row_order"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for each row, written so that it stays the same."""
    return written(docs.withColumn(KEY, F.monotonically_increasing_id()), "keyed")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, that of the smallest doc_id; rows without an id come last.

    Rows are grouped by their texts alone, so rows that repeat an id are one only if their texts are near, and copies
    without an id go like any other.  Of equal ids the least by a hash of the row stays, the same one in every run.
    Null and empty texts are one group.
    """
    order = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = _keyed(docs.withColumn(ORDER, order))
    groups = written(simhash.near_duplicates(keyed, id_col=KEY), "groups").select(F.col("id").alias(KEY), "component_id")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ORDER, KEY)
    least = keyed.select(KEY, "doc_id", ORDER).hint("merge").join(groups, KEY).groupBy("component_id").agg(F.min(rank).alias("least"))
    return keyed.join(least.select(f"least.{KEY}").hint("merge"), KEY, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold passages of the benchmark; each row by its own text, whatever its id.

    Null and empty texts hold none; an empty benchmark drops nothing.
    """
    keyed = _keyed(docs)
    found = written(decontam.contamination(keyed, table(spark, sf_dir, "benchmark"), id_col=KEY), "contamination")
    bad = found.where("contaminated").select(F.col("id").alias(KEY))
    return keyed.join(bad.hint("merge"), KEY, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left, as op6 returns them and with their ids.

    A null or empty text is its end id alone; rows that repeat an id are packed each; other columns are not read.
    """
    return packing.pack(docs, tokenizer("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Fingerprints, learned rules and token ids are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
