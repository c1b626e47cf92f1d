"""SimHash near-duplicate groups by blocks of bits that stay equal.

A 64-bit fingerprint is cut into six blocks.  Two fingerprints that differ in at
most three bits differ in at most three blocks, so they agree in the rest for one
of the twenty choices of three blocks that are left out.  Distinct fingerprints are
indexed under these choices, joined by equality and verified; crowded buckets are
cut into more and smaller blocks.  Links then become components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import connected_components, written

#: Hashes counted at a time in a task.
CHUNK = 1 << 17
#: Blocks that a fingerprint is cut into; each further number serves what the one before left in crowded buckets.  With
#: the last, three blocks left out are nine bits at most, so a bucket has at most 512 members.
BLOCKS = (6, 12, 22)


def _counted(hashes: list[int], ends: list[int]) -> np.ndarray:
    """The fingerprint of each run of hashes; a bit is set if it is set in over half of the run."""
    if not ends:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ends), np.uint64)
    starts = np.array([0, *ends[:-1]])
    sizes = np.array(ends) - starts
    full = sizes > 0
    if full.any():
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, starts[full], axis=0, dtype=np.int32)
        packed = np.packbits((2 * counts > sizes[full][:, None]).astype(np.uint8), axis=1, bitorder="little")
        out[full] = packed.copy().view("<u8").ravel()
    return out


def fingerprint_texts(texts: list[bytes | None], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit fingerprints of UTF-8 texts; no words give zero."""
    found, hashes, ends, digest = [], [], [], xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split() if text else []  # bytes: only ASCII letters fold, only ASCII white space splits
        if len(words) >= shingle:
            hashes += [digest(x, seed) for x in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))]
        elif words:
            hashes.append(digest(b" ".join(words), seed))
        ends.append(len(hashes))
        if len(hashes) >= CHUNK:
            found.append(_counted(hashes, ends))
            hashes, ends = [], []
    found.append(_counted(hashes, ends))
    return np.concatenate(found)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) for every row; null or empty text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fingerprint_texts(batch.column(1).cast(pa.binary()).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _masks(blocks: int, max_bits: int) -> list[int]:
    """For each choice of ``max_bits`` of the blocks the signed 64-bit mask of all others."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    left_out = [sum(c) for c in combinations([(1 << b) - (1 << a) for a, b in pairwise(ends)], max_bits)]
    return [~(x - (1 << 64) if x >> 63 else x) for x in left_out]


def _index(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, key): each fingerprint under every mask; choices that share a key by chance only make a bucket larger."""
    # each row makes as many as there are masks: dealt by number of rows, which sizes in bytes would understate
    dealt = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    places = dealt.select("fp", F.posexplode(F.array(*(F.lit(m) for m in masks))).alias("cut", "mask"))
    return places.select("fp", F.xxhash64("cut", F.expr("fp & mask")).alias("key"))


def links(fps: DataFrame, max_bits: int = 3, crowded: int = 496) -> DataFrame:
    """Links (a, b): all pairs of distinct ``fp`` that differ in at most ``max_bits`` (1 to 3).

    A bucket's members are compared where that makes at most ``crowded`` pairs
    for each of them.  Members of larger buckets are indexed again by more
    blocks (20, 220 and 1,540 choices for 3 bits) and in the end meet at most 512
    at a time, so the cost never grows with the square of a bucket.  No table is sent
    whole: Spark takes exploded rows for as small as their file.
    """
    if not 1 <= max_bits <= 3:
        raise ValueError("blocks are made for 1 to 3 bits")
    found, rest = [], fps
    for blocks in BLOCKS:
        index = _index(rest, _masks(blocks, max_bits))
        hot = F.lit(False) if blocks == BLOCKS[-1] else F.col("n") - 1 > 2 * crowded
        keys = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", hot.alias("hot"))
        members = written(index.hint("merge").join(keys, "key"), "members")
        cold = members.where("not hot")
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
        found.append(cold.select("key", F.col("fp").alias("a")).hint("merge").join(cold.select("key", F.col("fp").alias("b")), "key").where("a < b").where(near).select("a", "b"))
        if members.where("hot").isEmpty():
            break
        rest = written(members.where("hot").select("fp").distinct(), "crowded")
    return reduce(DataFrame.unionByName, found).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, crowded: int = 496) -> DataFrame:
    """One row per row of ``docs``: id, fp (16 hex digits), component_id (smallest id reachable through links).

    Equal fingerprints are one node from the start, so a group of copies of any
    size costs one row.  Null or empty texts have fingerprint zero and link like
    any other; rows that repeat an id come back as often; ids that are null are
    kept and never become a component's name while it has another id (else the
    name is null); other columns of ``docs`` are not read, whatever their names.
    An empty table gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = written(prints.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    labels = connected_components(links(fps, max_bits, crowded)).select(F.col("node").alias("fp"), "component")
    rooted = fps.hint("merge").join(labels, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.hint("merge").join(names, "root").select("fp", "component_id")
    return prints.hint("merge").join(named, "fp").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
