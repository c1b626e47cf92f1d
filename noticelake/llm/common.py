"""What several operators share: samples, ASCII word rules, connected components, and the written tables of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.store import fresh_path, remove, shared_dir, written

__all__ = ["ascii_lower", "connected_components", "fresh_path", "hash_sample", "remove", "shared_dir", "table", "written"]

#: The white space that separates words in the contracts.
SPACES = " \t\n\u000b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(rows: DataFrame, id_col: str, most_rows: int) -> DataFrame:
    """About ``most_rows`` of the rows, never more, chosen by a hash of the id: the same ones in every run.

    The share follows from a count, so that tasks send what is chosen and no
    more, however many tasks there are.  Should the share still give too many, those of
    the largest hashes go.
    """
    n = rows.count()
    if n <= most_rows:
        return rows
    share = max(0.0, most_rows - 4 * most_rows**0.5) / n  # the limit is then reached once in 30,000 runs
    drawn = F.pmod(F.xxhash64(F.lit(7), id_col), F.lit(1 << 30))
    return rows.where(drawn < int(share * (1 << 30))).orderBy(drawn, id_col).limit(most_rows)


def ascii_lower(text):
    """A-Z to a-z and nothing else; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (columns a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds.  A node's neighbours are
    never gathered in one place: only their minimum is, with partial
    aggregation.  The minima are written tables, so that both sides of each join
    are shuffles of their own and Spark can split a star's many edges; no side is
    sent, however small its file.  No edges give no rows.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or now[0] == 0:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.hint("merge").join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.hint("merge").join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = written(small.distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
