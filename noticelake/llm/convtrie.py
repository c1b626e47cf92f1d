"""A trie of conversations that share their beginnings, merged family by family.

A family is the conversations that borrow their first turns from one base.  Turns are
numbered, hashed and counted where they lie; a family's turns and the borrowed ones then meet in
one exchange, by family and block of depths, where prefixes get their hashes and equal
ones become one node of the family.  Only these combined nodes are moved again and merged
with those of other families.

A prefix's hash is the exclusive or of its turns' hashes, each made with its depth, twice
64 bits, so that running hashes of long conversations are put together block by block.  A
node is owned by its smallest conversation, and what a conversation owns is one
chain down to its end; sums over subtrees are sums along chains plus the totals of the chains
that branch off below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.llm.common import written

#: Depths of a conversation, and families of a list of ids, that are brought together.
BLOCK, FAMILIES = 256, 1_024
WORDS = r"[^\x20\x09-\x0D]+"
NODE = ("depth", "pa", "pb")


def _numbered(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, a, b, words, part, seq) of every turn: its hashes, and its place in a sort of all turns, in as many parts as Spark sees fit.

    Equal turns are ordered by role and text; equal rows, which are told apart by nothing, as they come.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    plain = rows.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).where("conv is not null")
    order = ["conv", "turn", "role", "text", "tie"]
    dealt = plain.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order).sortWithinPartitions(*order)
    hashed = dealt.select("conv", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"), F.regexp_count("text", F.lit(WORDS)).alias("words"))
    return written(hashed.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), "turns")


def _starts(turns: DataFrame) -> DataFrame:
    """(conv, part, first, n, before): where each conversation begins in a part, and how many turns it has there and in earlier parts."""
    found = turns.groupBy("conv", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    return found.withColumn("before", _before("n", ["conv"], "part"))


def _before(value: str, keys: list[str], order: str | Column) -> Column:
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def _rebuilt(turns: DataFrame, family: int, most_shared: int) -> tuple[DataFrame, DataFrame]:
    """((base, conv, len, depth, ta, tb, words) of every rebuilt turn and, at depth 0, conversation; (conv, base, len) of every conversation)."""
    starts = written(_starts(turns), "starts")
    place = F.col("before") + F.col("seq") - F.col("first") + 1
    bases = starts.where(F.col("conv") % family == 0)
    heads = turns.where(F.col("conv") % family == 0).join(bases, ["conv", "part"]).withColumn("i", place).where(F.col("i") < most_shared)
    lent = heads.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "a", "b", "words"))).alias("lent"))  # fewer than most_shared
    convs = starts.groupBy("conv").agg(F.sum("n").alias("own")).withColumn("base", F.col("conv") - F.col("conv") % family)
    convs = convs.withColumn("h", F.crc32(F.col("conv").cast("string")) % most_shared).join(lent, "base", "left")
    convs = convs.withColumn("lent", F.when(F.col("lent").isNull(), F.array()).otherwise(F.slice("lent", F.lit(1), F.col("h").cast("int"))))
    convs = convs.withColumn("lb", F.size("lent").cast("long")).withColumn("len", F.col("lb") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    convs = written(convs.select("conv", "base", "h", "lb", "len", "lent"), "conversations")

    placed = turns.join(starts.join(convs.select("conv", "base", "h", "lb", "len"), "conv"), ["conv", "part"]).withColumn("i", place).where("i > h")
    own = placed.select("base", "conv", "len", (F.col("lb") + F.col("i") - F.col("h")).alias("depth"), "a", "b", "words")
    borrowed = convs.select("base", "conv", "len", F.posexplode("lent").alias("k", "t")).select("base", "conv", "len", (F.col("k") + 1).cast("long").alias("depth"), "t.a", "t.b", "t.words")
    roots = convs.select("base", "conv", "len", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("words"))
    every = own.unionByName(borrowed).unionByName(roots)
    hashed = lambda seed, c: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), "depth", c))
    rows = every.select("base", "conv", "len", "depth", _block("depth").alias("block"), hashed(3, "a").alias("ta"), hashed(4, "b").alias("tb"), "words")
    return written(rows, "rebuilt"), convs


def _block(depth: str) -> Column:
    """The block of depths that a turn is in; the root is in the first."""
    return F.expr(f"greatest({depth} - 1, 0) div {BLOCK}")


def _prefixed(rows: DataFrame) -> DataFrame:
    """``rows`` with the hash of each prefix (pa, pb) and of its parent (qa, qb), dealt by family and block of depths and by nothing else."""
    blocks = rows.where(F.col("len") > BLOCK).groupBy("base", "block", "conv").agg(F.bit_xor("ta").alias("xa"), F.bit_xor("tb").alias("xb"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = blocks.select("base", "block", "conv", F.struct(F.bit_xor("xa").over(earlier).alias("a"), F.bit_xor("xb").over(earlier).alias("b")).alias("x")).where("block > 0")
    begun = begun.groupBy("base", "block").agg(F.map_from_entries(F.collect_list(F.struct("conv", "x"))).alias("begun"))  # a family is few conversations
    so_far = Window.partitionBy("base", "block", "conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.join(begun, ["base", "block"], "left").withColumn("x", F.try_element_at("begun", F.col("conv")))
    start = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit(0).cast("long"))
    hashed = met.withColumns({"pa": F.bit_xor("ta").over(so_far).bitwiseXOR(start("a")), "pb": F.bit_xor("tb").over(so_far).bitwiseXOR(start("b"))})
    return hashed.select("base", "block", "conv", "len", "depth", "pa", "pb", F.col("pa").bitwiseXOR(F.col("ta")).alias("qa"), F.col("pb").bitwiseXOR(F.col("tb")).alias("qb"), "words")


def _family_nodes(prefixes: DataFrame, family: int) -> DataFrame:
    """Each family's small trie, a block of depths at a time: one row a node with the members that it has in the family; ``ends`` has a bit for each that ends there."""
    ending = F.when(F.col("depth") == F.col("len"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("conv") % family + family - 1).cast("int"))).otherwise(F.lit(0).cast("long"))
    nodes = prefixes.groupBy("base", "block", *NODE).agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("words").alias("words"), F.min("qa").alias("qa"), F.min("qb").alias("qb"), F.bit_or(ending).alias("ends"))
    return written(nodes, "family-nodes")


def _ends(family_nodes: DataFrame, family: int) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end.

    Lists of ids are written in pieces of FAMILIES families and hashed piece
    by piece in their order, so that a list of any length is never held as a whole.
    """
    wide = FAMILIES * family
    some = family_nodes.where("ends <> 0").withColumn("piece", F.floor(F.col("base") / wide))
    bits = F.filter(F.sequence(F.lit(0), F.lit(2 * family - 2)), lambda k: F.getbit("ends", k) == 1)
    ids = some.select(*NODE, "piece", F.explode(F.transform(bits, lambda k: F.col("base") + k - (family - 1))).alias("id"))
    said = ids.groupBy(*NODE, "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("ids"))
    dealt = said.repartition(*NODE).sortWithinPartitions(*NODE, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out: list[tuple] = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key != node:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield _batch(out)
        if node is not None:
            yield _batch([(*node, digest.hexdigest())])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], [*NODE, "ends_sha256"])

    return dealt.mapInArrow(run, "depth long, pa long, pb long, ends_sha256 string")


def _hanging(prefixes: DataFrame, valued: DataFrame, family: int) -> DataFrame:
    """(node, leaves, saved) of what hangs below a node on chains that its own owner does not own.

    A chain's totals go to every prefix of its conversation above its top: first within
    the family, where the prefixes are, then over all families.
    """
    chains = valued.groupBy("conv").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")).where("top > 0")
    totals = F.struct("conv", F.struct("top", "leaves", "saved").alias("t"))
    chains = chains.withColumn("base", F.col("conv") - F.col("conv") % family).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(top - 2, 0) div {BLOCK}"))))
    sent = chains.groupBy("base", "block").agg(F.map_from_entries(F.collect_list(totals)).alias("chains"))
    met = prefixes.join(sent, ["base", "block"]).withColumn("t", F.try_element_at("chains", F.col("conv"))).where("depth < t.top")
    return met.groupBy("base", "block", *NODE).agg(F.sum("t.leaves").alias("l"), F.sum("t.saved").alias("s")).groupBy(*NODE).agg(F.sum("l").alias("hung_leaves"), F.sum("s").alias("hung_saved"))


def prefix_trie(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 20, most_shared: int = 4) -> DataFrame:
    """One row for each node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation c is rebuilt of the first crc32(c) % ``most_shared`` turns of the base of
    its family, c - c % ``family``, and of its own turns behind as many.  Nodes are distinct
    sequences of first turns, from the root; a node is named by its smallest member
    and its depth.  Turns are in order of turn (null first), then role and text; null
    roles and texts are empty; repeated rows are turns of their own; rows without a
    conversation's id belong to none and are left out.  Other columns are not read.  No
    rows give no nodes, not even the root.
    """
    if not 2 <= family <= 31 or most_shared < 1:
        raise ValueError("a family is 2 to 31 conversations")
    turns = _numbered(rows, conv_col, turn_col, role_col, text_col)
    rebuilt, _ = _rebuilt(turns, family, most_shared)
    prefixes = _prefixed(rebuilt)
    families = _family_nodes(prefixes, family)
    nodes = families.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.sum("n").alias("n_convs"), F.max("words").alias("words"), F.min("qa").alias("qa"), F.min("qb").alias("qb"))
    nodes = written(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("qa").alias("pa"), F.col("qb").alias("pb")).agg(F.count("*").alias("n_children"))
    n_children = F.coalesce("n_children", F.lit(0))
    valued = nodes.join(children, list(NODE), "left").select(*NODE, "qa", "qb", "conv", "n_convs", n_children.alias("n_children"), (n_children == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), _block("depth").alias("block"))
    valued = written(valued, "valued")

    # along a chain: the rest of a node's own block, and all later blocks
    rest = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = valued.groupBy("conv", "block").agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s"))
    later = blocks.select("conv", "block", _before("l", ["conv"], F.desc("block")).alias("later_leaves"), _before("s", ["conv"], F.desc("block")).alias("later_saved"))
    chained = valued.withColumns({"rest_leaves": F.sum("leaf").over(rest), "rest_saved": F.sum("saved").over(rest)}).join(later, ["conv", "block"])
    summed = chained.join(_hanging(prefixes, valued, family), list(NODE), "left").join(_ends(families, family), list(NODE), "left")
    parents = valued.select((F.col("depth") + 1).alias("depth"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("conv").alias("parent_conv_id"))
    named = summed.join(parents, ["depth", "qa", "qb"], "left")
    hung = lambda c: F.coalesce(c, F.lit(0))
    leaves = F.col("rest_leaves") + F.col("later_leaves") + hung("hung_leaves")
    saved = F.col("rest_saved") + F.col("later_saved") + hung("hung_saved")
    return named.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", leaves.alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
