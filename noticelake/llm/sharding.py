"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many virtual nodes on a ring; a key belongs to the next virtual
node clockwise.  Keys that find their shard full go on clockwise to the next
virtual node of one that is not.  The loads are counted per ring point, so the
overflow is decided on a table whose size is fixed by the ring, and every row
then looks up its place by its rank at its point.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.llm.common import written

#: A ring has at least so many points, and room for four times its virtual nodes.
LEAST_POINTS = 1 << 14
#: The most virtual nodes of a ring: bounds the table of loads and the broadcast of places.
MOST_NODES = 1 << 18
#: Equal rows are counted in portions of so many.
PORTION = 1 << 16
#: Rows at one point are ranked in so many parts of their own.
SALTS = 64


def ring_points(n_shards: int, replicas: int) -> int:
    """Points of a ring, a power of two: a matter of its shards, never of the rows."""
    if n_shards < 1 or replicas < 1 or n_shards * replicas > MOST_NODES:
        raise ValueError(f"a ring takes 1 to {MOST_NODES} virtual nodes, not {n_shards} x {replicas}")
    return max(LEAST_POINTS, 1 << (4 * n_shards * replicas - 1).bit_length())


def virtual_nodes(n_shards: int, replicas: int) -> list[tuple[int, int]]:
    """(point, shard) clockwise; each shard has all its nodes, and adding a shard moves no other's on a ring of that size.

    A node whose point is taken goes to the next free one.
    """
    points = ring_points(n_shards, replicas)
    taken: dict[int, int] = {}
    for shard in range(n_shards):
        for k in range(replicas):
            point = zlib.crc32(f"shard {shard} node {k}".encode()) * points >> 32
            while point in taken:
                point = (point + 1) % points
            taken[point] = shard
    return sorted(taken.items())


def capacities(loads: Sequence[int], slack: float) -> list[int]:
    """Rows each shard may hold, of shards that ``loads`` rows belong to at first.

    Without slack these add up to all rows and differ by one at most, the
    larger ones where most rows belong.
    """
    total, n = sum(loads), len(loads)
    if slack:
        return [-int(-total * (1 + slack) // n)] * n
    larger = set(sorted(range(n), key=lambda s: (-loads[s], s))[: total % n])
    return [total // n + (s in larger) for s in range(n)]


def places(counts: dict[int, int], n_shards: int, replicas: int = 128, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """(point, from rank, to rank, shard, first slot) for rows counted by ring point."""
    if slack < 0:
        raise ValueError("shards must have room for all rows")
    nodes = virtual_nodes(n_shards, replicas)
    at, shard_of = [p for p, _ in nodes], [s for _, s in nodes]
    waiting = [(point, 0, n, bisect_left(at, point) % len(nodes)) for point, n in sorted(counts.items())]
    loads = [0] * n_shards
    for _, _, n, node in waiting:
        loads[shard_of[node]] += n
    room, placed, following = capacities(loads, slack), [], list(range(len(nodes)))

    def open_from(node: int) -> int:
        """The next node clockwise, itself included, of a shard with room; what is passed once is skipped for good."""
        path = []
        while not room[shard_of[node]]:
            path.append(node)
            step = following[node]
            node = step if step != node else (node + 1) % len(nodes)
        for p in path:
            following[p] = node
        return node

    while waiting:
        over = []
        for point, low, high, node in waiting:
            shard = shard_of[node]
            fits = min(high, low + room[shard])
            if fits > low:
                placed.append((point, low, fits, shard))
                room[shard] -= fits - low
            if fits < high:
                over.append((point, fits, high, node))
        waiting = [(point, low, high, open_from(node)) for point, low, high, node in over]
    slots, out = [0] * n_shards, []
    for point, low, high, shard in sorted(placed):
        out.append((point, low, high, shard, slots[shard]))
        slots[shard] += high - low
    return out


def shard_rows(rows: DataFrame, key: Column, n_shards: int, replicas: int = 128, slack: float = 0.0) -> DataFrame:
    """``rows`` with shard (int) and slot (long, gapless from 0 in each shard).

    Counts of shards differ by one at most, or with ``slack`` stay under
    (1 + slack) times the mean.  Pass narrow rows of sortable columns.  Equal
    rows are counted before anything is shuffled and parted again at the end, and
    rows at one ring point are ranked in ``SALTS`` parts, so neither a row nor a
    key that a third of all rows have comes to one task.  The order at a point is
    by a hash of the row, so equal rows may swap but the result is the same.  Rows
    with a null key share a point unless the key expression tells them apart.
    No rows give no rows.
    """
    spark, names = rows.sparkSession, rows.columns
    if any(c.lower() in ("shard", "slot") or c.startswith("ring_") for c in names):
        raise ValueError("rows must not have columns shard, slot or ring_*")
    points = ring_points(n_shards, replicas)
    columns = [F.col(f"`{c}`") for c in names]
    counted = rows.groupBy(*columns).agg(F.count("*").alias("ring_n"))
    portions = counted.withColumn("ring_portion", F.explode(F.sequence(F.lit(0), F.floor((F.col("ring_n") - 1) / PORTION))))
    portions = portions.withColumn("ring_n", F.least(F.lit(PORTION), F.col("ring_n") - F.col("ring_portion") * PORTION))
    row_hash = F.xxhash64(*columns, "ring_portion")
    keyed = portions.withColumns({"ring_point": F.pmod(F.xxhash64(key), F.lit(points)).cast("int"), "ring_hash": row_hash, "ring_salt": F.pmod(row_hash, F.lit(SALTS)).cast("int")})
    keyed = written(keyed, "ring-rows")
    by_salt = keyed.groupBy("ring_point", "ring_salt").agg(F.sum("ring_n").alias("ring_n"))
    counts = {r.ring_point: r.n for r in by_salt.groupBy("ring_point").agg(F.sum("ring_n").alias("n")).collect()}  # as many rows as the ring has points
    plan = spark.createDataFrame(places(counts, n_shards, replicas, slack), "ring_point int, ring_low long, ring_high long, shard int, ring_slot long")
    before = lambda window: F.coalesce(F.sum("ring_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = by_salt.select("ring_point", "ring_salt", before(Window.partitionBy("ring_point").orderBy("ring_salt")).alias("ring_first"))
    ranked = keyed.withColumn("ring_rank", before(Window.partitionBy("ring_point", "ring_salt").orderBy("ring_hash", *columns, "ring_portion")))
    ranked = ranked.join(firsts.hint("merge"), ["ring_point", "ring_salt"]).withColumn("ring_rank", F.col("ring_rank") + F.col("ring_first"))
    found = ranked.join(F.broadcast(plan), "ring_point").where("ring_rank < ring_high and ring_rank + ring_n > ring_low")
    low, high = F.greatest("ring_rank", "ring_low"), F.least(F.col("ring_rank") + F.col("ring_n"), "ring_high")
    return found.select(*columns, "shard", F.explode(F.sequence(F.col("ring_slot") + low - F.col("ring_low"), F.col("ring_slot") + high - F.col("ring_low") - 1)).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, size (UTF-8 bytes and one more), text_crc32, shard and slot for each row of ``docs``.

    A null text has size 1 and the checksum of an empty one.  A row without an
    id is placed by its text.  Repeated rows get slots of their own.  Other
    columns are not read.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    return shard_rows(rows, F.coalesce("id", F.xxhash64("size", "text_crc32")), n_shards, **options)
