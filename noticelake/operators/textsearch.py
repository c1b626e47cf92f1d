"""Texts that hold other texts: a large query set joined by shared pieces, and an index of trigrams for single queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.store import written

#: Up to so many needles with so many bytes together go to every task as one automaton; more meet the texts' pieces in a shuffle.
MOST_SENT, MOST_BYTES = 200_000, 1 << 23
#: Up to so many needles are compared with every text as it is read, which is then quicker than its pieces.
FEW = 100
#: Lengths of the pieces by which query texts are found; a query text uses the largest that it has room for.
SIZES = (16, 8, 4, 2, 1)
#: Characters of a text that are looked at together.
STRETCH = 1_000
#: Characters whose trigrams of one bucket are sorted by a task.
PART = 1 << 26
#: Two of these behind an indexed text make each of its last characters the beginning of a trigram.
END = "\u0003"


def _pieces(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters; one pass, as substrings of long texts would each be counted out from the beginning."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1)))


def _stretches(text: Column, longest: int) -> Column:
    """A text cut up, each stretch with as much of the next as a piece of ``longest`` characters may reach into."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{STRETCH + longest - 1}}})).{{1,{STRETCH}}}"), F.lit(1))


def _keys(text: Column) -> dict[str, Column]:
    """128 bits that stand for a text."""
    return {"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text)}  # the constant first: behind the text it would add nothing


KEYS = ["__h1", "__h2"]


def _anchored(words: DataFrame, sizes: list[int]) -> DataFrame:
    """(needle, gram): of each needle the piece that the fewest needles share, as a hash."""
    length = F.char_length("needle")
    of_size = F.array(F.lit(""))  # an empty needle, which every text holds
    for size in reversed(sizes):
        of_size = F.when(length >= size, _pieces(F.col("needle"), size)).otherwise(of_size)
    pieces = words.select("needle", F.explode(of_size).alias("piece")).select("needle", F.xxhash64("piece").alias("gram"))
    often = pieces.groupBy("gram").agg(F.count("*").alias("n"))
    return pieces.hint("merge").join(often, "gram").groupBy("needle").agg(F.min(F.struct("n", "gram")).alias("a")).select("needle", "a.gram")


def _met_pieces(keyed: DataFrame, words: DataFrame, sizes: list[int], empty: bool) -> DataFrame:
    """(keys, needle) where a text has the needle's piece; both sides move by it."""
    grams = F.flatten(F.array(*(_pieces(F.col("stretch"), s) for s in sizes), F.array().cast("array<string>")))
    met = keyed.select(*KEYS, F.explode(_stretches(F.col("__text"), max(sizes, default=1))).alias("stretch")).select(*KEYS, F.explode(grams).alias("piece"))
    if empty:
        met = met.unionByName(keyed.select(*KEYS, F.lit("").alias("piece")))
    # Spark takes exploded pieces for as small as their file and would send them, so it is told what to do
    return met.select(*KEYS, F.xxhash64("piece").alias("gram")).hint("merge").join(_anchored(words, sizes), "gram").select(*KEYS, "needle")


@lru_cache(maxsize=1)
def _automaton(words: frozenset[bytes]):
    """One pass over a text finds all of the words.  A byte is a character here, so that parts are held as Spark's own comparison says."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for word in words:
        made.add_word(word.decode("latin-1"), word)
    made.make_automaton()
    return made


def _held_by_automaton(keyed: DataFrame, words: DataFrame) -> DataFrame:
    """(keys, needle) of texts and needles that they hold, each text in one pass where it lies; the needles are few enough to be sent."""
    every = frozenset(bytes(r.needle) for r in words.select(F.col("needle").cast("binary").alias("needle")).collect())
    sent = keyed.sparkSession.sparkContext.broadcast(every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = sent.value
        always, find = [w for w in given if not w], _automaton(frozenset(w for w in given if w)) if any(given) else None
        for batch in batches:
            rows, needles = [], []
            for k, text in enumerate(batch.column(2)):
                text = text.as_buffer().to_pybytes().decode("latin-1")
                found = always + list({w for _, w in find.iter(text)} if find else ())
                rows += [k] * len(found)
                needles += found
                if len(needles) >= MOST_SENT:
                    yield told(batch, rows, needles)
                    rows, needles = [], []
            yield told(batch, rows, needles)

    def told(batch: pa.RecordBatch, rows: list[int], needles: list[bytes]) -> pa.RecordBatch:
        keys = (batch.column(i).take(pa.array(rows, pa.int32())) for i in (0, 1))
        return pa.RecordBatch.from_arrays([*keys, pa.array(needles, pa.binary())], [*KEYS, "needle"])

    found = keyed.select(*KEYS, F.col("__text").cast("binary").alias("text")).mapInArrow(run, "__h1 long, __h2 long, needle binary")
    return found.select(*KEYS, F.col("needle").cast("string").alias("needle"))


def held(rows: DataFrame, text: Column, needles: DataFrame, needle_col: str) -> DataFrame:
    """(``__h1``, ``__h2``, needle) of each distinct text and each needle that it holds.

    Up to ``MOST_SENT`` needles of ``MOST_BYTES`` together become an automaton that every task has: each text is read
    once, where it lies, and only what it holds is sent on.  More needles are found by their pieces: of each the piece
    of 16, 8, 4, 2 or 1 characters that the fewest needles share meets the texts' pieces of these sizes by equality, and
    what meets is compared; then neither side passes through the driver.  Either way the work is linear in the texts and in
    what they hold, and nothing is missed.  Null texts hold nothing, null needles are in none, an empty needle is in every
    text.  The result is a written table, whose true size tells Spark whether texts have to move for it.
    """
    words = needles.select(F.col(f"`{needle_col}`").cast("string").alias("needle")).where("needle is not null").distinct()
    length = F.char_length("needle")
    least = [F.max((length >= s) & (length < b)).alias(str(s)) for s, b in zip((*SIZES, 0), (1 << 30, *SIZES), strict=True)]
    found = words.agg(*least, F.count("*").alias("n"), F.sum(F.octet_length("needle")).alias("bytes")).first()  # how many there are and of which sizes: one row
    keyed = rows.select(text.alias("__text")).where("__text is not null").select("__text", *(c.alias(k) for k, c in _keys(F.col("__text")).items()))
    if found["n"] <= MOST_SENT and (found["bytes"] or 0) <= MOST_BYTES:
        return written(_held_by_automaton(keyed, words).distinct(), "held")
    likely = written(_met_pieces(keyed, words, [s for s in SIZES if found[str(s)]], bool(found["0"])).distinct(), "likely")
    return written(keyed.join(likely, KEYS).where(F.contains("__text", "needle")).select(*KEYS, "needle").distinct(), "held")


def _marked(rows: DataFrame, text: Column) -> DataFrame:
    """Rows with their text's keys, null where there is no text."""
    return rows.withColumns({k: F.when(text.isNotNull(), c) for k, c in _keys(text).items()})


def holds_any(rows: DataFrame, text: Column, needles: DataFrame, needle_col: str) -> DataFrame:
    """Rows whose text holds any of the needles: up to ``FEW`` by plain comparison, more as :func:`held` finds them.  Rows that repeat stay as often as they are there."""
    words = needles.select(F.col(f"`{needle_col}`").cast("string").alias("needle")).where("needle is not null").distinct()
    if words.limit(FEW + 1).count() <= FEW:
        few = rows.withColumn("__few", words.agg(F.collect_list("needle").alias("few")).scalar())
        hit = F.transform(F.array(text), lambda t: F.exists("__few", lambda w: F.contains(t, w)))[0]
        return few.where(F.coalesce(hit, F.lit(False))).drop("__few")
    return _marked(rows, text).join(held(rows, text, needles, needle_col).select(*KEYS).distinct(), KEYS, "left_semi").select(*(F.col(f"`{c}`") for c in rows.columns))


def first_group(rows: DataFrame, text: Column, groups: DataFrame, unknown: str, name: str = "district") -> DataFrame:
    """Adds ``name``: of the groups (rank, name, keyword) with a keyword in the lower-cased text that of the least rank, or ``unknown``.

    As :func:`noticelake.functions.text.first_match`, with the keywords as a table of any size; of equal ranks the least name.
    """
    text = F.lower(text)
    ranked = groups.select("rank", F.col("name").alias("__name"), F.col("keyword").alias("needle")).distinct()
    best = held(rows, text, groups, "keyword").join(ranked, "needle").groupBy(*KEYS).agg(F.min(F.struct("rank", "__name")).alias("__best"))
    told = _marked(rows, text).join(best, KEYS, "left")
    return told.select(*(F.col(f"`{c}`") for c in rows.columns if c != name), F.coalesce("__best.__name", F.lit(unknown)).alias(name))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, gram): the distinct three characters one after another of each text (id, text)."""
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            found = [list({text[i : i + 3] for i in range(len(text) - 2)}) for text in part.column(1).to_pylist()]
            at = pa.array([j for j, grams in enumerate(found) for _ in grams], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array([g for grams in found for g in grams], pa.string())], ["id", "gram"])


class TrigramIndex:
    """Which ids have which three characters one after another in any of their texts, whatever the case.

    Postings lie in folders by a hash of the trigram, sorted by it, so that a query reads the row groups of its own
    trigrams.  They are intersected from the rarest; what is left is a superset of the answer and is compared with the rows.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long", buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schemas = {"postings": f"id {id_type}, gram string, bucket int", "counts": "gram string, n long, bucket int"}

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def build(self, rows: DataFrame, id_col: str, *texts: Column) -> None:
        """Indexes texts, each a string column or an array of strings; null texts are left out, rows without an id too.

        The buckets are cut by id as well, into parts of about ``PART`` characters, so what a task sorts does not grow with the texts.
        """
        every = F.flatten(F.array(*texts)) if all(self._is_array(rows, t) for t in texts) else F.array(*texts)
        said = rows.select(F.col(f"`{id_col}`").alias("id"), F.explode(every).alias("text")).where("id is not null and text is not null")
        grams = said.select("id", F.concat(F.lower("text"), F.lit(END * 2)).alias("text")).mapInArrow(_grams, f"id {said.schema['id'].dataType.simpleString()}, gram string")
        parts = max(8, -(-(said.agg(F.sum(F.char_length("text"))).first()[0] or 0) // PART))
        placed = grams.withColumns({"bucket": self._bucket(F.col("gram")), "part": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")})
        # rows that are equal are in one part of a bucket, so that they fall out where they are sorted
        once = placed.repartition(self.buckets * parts, "bucket", "part").dropDuplicates()
        once.sortWithinPartitions("bucket", "gram", "id").drop("part").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        counts = self._table("postings").groupBy("bucket", "gram").agg(F.count("*").alias("n"))
        counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/counts")

    @staticmethod
    def _is_array(rows: DataFrame, text: Column) -> bool:
        return rows.select(text.alias("t")).schema["t"].dataType.typeName() == "array"

    def _read(self, name: str, grams: list[str]) -> DataFrame:
        """Rows of these trigrams; folders and row groups of others are not read."""
        here = reduce(lambda a, b: a | b, ((F.col("bucket") == self._bucket(F.lit(g))) & (F.col("gram") == g) for g in grams))
        return self._table(name).where(here)

    def candidates(self, query: str, rarest: int = 4) -> DataFrame:
        """(id) of all rows that may hold the query, each once; the ``rarest`` of its trigrams decide.  An empty query has no index to ask."""
        if not query:
            raise ValueError("an empty query is in every text")
        query = self.spark.range(1).select(F.lower(F.lit(query))).first()[0]
        if len(query) < 3:
            return self._table("postings").where(F.col("gram").startswith(query)).select("id").distinct()
        grams = sorted({query[i : i + 3] for i in range(len(query) - 2)})
        counted = sorted((r.n, r.gram) for r in self._read("counts", grams).collect())  # as many as the query has
        if len(counted) < len(grams):
            return self._table("postings").select("id").limit(0)
        asked = [gram for _, gram in counted[:rarest]]
        return self._read("postings", asked).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(asked)).select("id")

    def search(self, rows: DataFrame, id_col: str, query: str, *texts: Column) -> DataFrame:
        """Rows of which a text holds the query, whatever the case; ``texts`` as they were indexed.  An empty query finds all rows.

        The comparison names a column of the candidates, so it is made for them alone and not for every row on the way.
        """
        if not query:
            return rows
        wanted = F.lower(F.lit(query))
        likely = self.candidates(query).select(F.col("id").alias("__id"), F.when(F.col("id").isNotNull(), wanted).alias("__query"))
        hit = F.lit(False)
        for text in texts:
            every = text if self._is_array(rows, text) else F.array(text)
            hit = hit | F.coalesce(F.exists(every, lambda x: F.contains(F.lower(x), F.col("__query"))), F.lit(False))
        return rows.join(likely, (F.col(f"`{id_col}`") == F.col("__id")) & hit, "left_semi")
