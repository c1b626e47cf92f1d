"""Benchmark decontamination over a distributed positional inverted index.

The training corpus is indexed once, whatever benchmarks come later: texts are
gathered into segments of a bounded number of words, and for each segment a term
has one row of postings, the documents and places where it occurs.  Segments are
independent, so an index grows by adding some.

A benchmark is cut into windows.  Each starts from the postings of its rarest
term; in every segment that has that term the lists of the window's other terms,
shifted by their offsets, are intersected with it from the next rarest on, until
the whole phrase is confirmed or nothing is left.  With a slop the shifted lists
may miss each other by that many words (proximity).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.llm.common import fresh_path, remove, written

#: Of all bytes: A-Z fold, digits, a-z and what is not ASCII stay, the rest separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A segment takes no more texts once it has so many words or texts.
SEGMENT_WORDS, SEGMENT_TEXTS = 1 << 20, 1 << 20
#: A posting as one number: the text's place in its segment above, the word's place in the text below.
PLACE_BITS = 32


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class _Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def segment_rows(segment: int, ids: list[int | None], lengths: list[int], numbers: list[np.ndarray], names: list[bytes]) -> Iterator[pa.RecordBatch]:
    """A segment's rows: first its texts (id, n_words, docs: their place), then its terms with their postings in order."""
    flat, sizes = np.concatenate([*numbers, np.zeros(0, np.int32)]), np.array(lengths, np.int64)
    order = np.argsort(flat, kind="stable")
    docs = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order]
    places = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)[order]
    counts = np.bincount(flat, minlength=len(names))

    def rows(term, found, n, ends, docs, places):
        lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (docs, places))
        columns = [pa.array(np.full(len(term), segment)), pa.array(term, pa.string()), pa.array(found, pa.int64()), pa.array(n, pa.int64()), *lists]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in INDEX.split(", ")])

    every = np.arange(len(ids) + 1)
    yield rows([None] * len(ids), ids, lengths, every, every[:-1], every[:-1] * 0)
    if names:
        yield rows([n.decode(errors="replace") for n in names], [None] * len(names), counts, np.concatenate([[0], np.cumsum(counts)]), docs, places)


INDEX = "segment long, term string, id long, n long, docs array<int>, places array<int>"


@dataclass(frozen=True)
class Index:
    """A stored index; rows without a term are texts."""

    rows: DataFrame
    path: str

    @property
    def documents(self) -> DataFrame:
        """(uid, id, n_words) of every text; uid tells texts that share an id apart."""
        texts = self.rows.where("term is null")
        return texts.select(_uid("segment", F.col("docs")[0]).alias("uid"), "id", F.col("n").alias("n_words"))

    @property
    def postings(self) -> DataFrame:
        """(segment, term, n, docs, places): a term's occurrences in a segment, in order."""
        return self.rows.where("term is not null").select("segment", "term", "n", "docs", "places")


def _uid(segment, doc):
    return F.shiftleft(F.col(segment), 20).bitwiseOR(doc.cast("long"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> Index:
    """The positional index of all words of all texts, written to ``path`` (default: the shared folder, for this run).

    Null and empty texts are indexed as texts without words; ids may be null or
    repeated.  A segment ends at ``SEGMENT_WORDS`` words, so a task holds one
    segment at a time, whatever it reads; one longer text is a segment by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 23
        ids, lengths, numbers, names = [], [], [], _Numbers()
        total = 0
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = words_of(text.as_py())
                ids.append(ident)
                lengths.append(len(words))
                numbers.append(np.array(list(map(names.__getitem__, words)), np.int32))
                total += len(words)
                if total >= SEGMENT_WORDS or len(ids) >= SEGMENT_TEXTS:
                    yield from segment_rows(segment, ids, lengths, numbers, list(names))
                    segment, total = segment + 1, 0
                    ids, lengths, numbers, names = [], [], [], _Numbers()
        if ids:
            yield from segment_rows(segment, ids, lengths, numbers, list(names))

    path = path or fresh_path(docs.sparkSession, "index")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    source.mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(path)
    return open_index(docs.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.schema(INDEX).parquet(path), path)


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 13) -> tuple[DataFrame, DataFrame]:
    """(terms, owners) of the distinct windows: terms (window_id, len, place, term), owners (window_id, item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, windows = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text)
                for i in range(max(1, len(words) - size + 1) if words else 0):
                    ids.append(item)
                    windows.append(b" ".join(words[i : i + size]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(windows, pa.string())], ["item", "phrase"])

    cut = written(items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "item string, phrase string").distinct(), "windows")
    named = written(cut.select("phrase").distinct().withColumn("window_id", F.monotonically_increasing_id()), "phrases")
    words = named.select("window_id", F.split("phrase", " ").alias("words"))
    terms = words.select("window_id", F.size("words").alias("len"), F.posexplode("words").alias("place", "term"))
    return written(terms, "window-terms"), written(cut.where("item is not null").join(named, "phrase").select("window_id", "item"), "owners")


def ranked_windows(index: Index, terms: DataFrame) -> DataFrame:
    """(window_id, terms) of the windows whose terms all occur: each term as (n, place, term), the rarest in the corpus first."""
    wanted = terms.select("term").distinct()
    counts = index.postings.select("term", "n").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    ranked = terms.join(counts, "term", "left").groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "term"))).alias("terms"))  # as many as a window has words
    return written(ranked.where("terms[0].n > 0"), "ranked")


def intersected(lists: list[tuple[np.ndarray, int]], slop: int) -> np.ndarray:
    """The anchors, postings of the first list, from which every other list has a posting at its offset, give or take ``slop``.

    Lists are (sorted postings, offset); the work ends as soon as none is left.
    """
    anchors, first = lists[0]
    for postings, place in lists[1:]:
        at = anchors + (place - first)
        if slop:
            met = np.searchsorted(postings, at + slop, "right") > np.searchsorted(postings, at - slop, "left")
        else:
            met = postings[np.minimum(np.searchsorted(postings, at), len(postings) - 1)] == at
        anchors = anchors[met]
        if not len(anchors):
            break
    return anchors


def phrase_matches(index: Index, items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", size: int = 13, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """(matches, owners) of every occurrence of a benchmark window in the indexed corpus.

    matches: (uid, window_id, len, start); with a slop each term may stand so
    many words from its place, counted from the rarest term's (proximity).
    owners: (window_id, item).  Only postings of the benchmark's terms are moved,
    each to its segment, and a segment's are met by the windows whose rarest term it has.
    """
    terms, owners = benchmark_windows(items, item_col, item_text_col, size)
    ranked = ranked_windows(index, terms)
    rarest = ranked.select(F.col("terms")[0]["term"].alias("term"), "window_id", F.col("terms.term").alias("words"), F.col("terms.place").alias("offsets"))
    windows = index.postings.select("segment", "term").join(rarest, "term").select(F.col("segment").alias("of_segment"), "window_id", "words", "offsets")
    needed = ranked.select(F.explode("terms.term").alias("term")).distinct()
    lists = index.postings.select("segment", "term", "docs", "places").join(needed, "term", "left_semi")

    def run(held: pa.Table, wanted: pa.Table) -> pa.Table:
        out, postings = [], {}
        if wanted.num_rows:
            columns = [held.column(c).combine_chunks() for c in ("docs", "places")]
            ends = columns[0].offsets.to_numpy()
            codes = (columns[0].values.to_numpy().astype(np.int64) << PLACE_BITS) | columns[1].values.to_numpy()
            for k, term in enumerate(held.column("term").to_pylist()):
                mine = codes[ends[k] - ends[0] : ends[k + 1] - ends[0]]
                postings[term] = np.sort(np.concatenate([postings[term], mine])) if term in postings else mine
            for segment, window, words, offsets in zip(*(wanted.column(c).to_pylist() for c in ("of_segment", "window_id", "words", "offsets")), strict=True):
                found = [(postings.get(w), at) for w, at in zip(words, offsets, strict=True)]
                if all(p is not None for p, _ in found):
                    anchors = intersected(found, slop)
                    if len(anchors):
                        out.append((np.int64(segment << 20) | (anchors >> PLACE_BITS), window, len(words), (anchors & ((1 << PLACE_BITS) - 1)) - offsets[0]))
        sizes = [len(u) for u, *_ in out]
        uids, starts = (np.concatenate([x[k] for x in out] + [np.zeros(0, np.int64)]) for k in (0, 3))
        fixed = (np.repeat(np.array([x[k] for x in out], np.int64), sizes) for k in (1, 2))
        return pa.table([pa.array(c) for c in (uids, *fixed, starts)], names=["uid", "window_id", "len", "start"])

    found = lists.groupBy("segment").cogroup(windows.groupBy("of_segment")).applyInArrow(run, "uid long, window_id long, len long, start long")
    return written(found, "matches"), owners


def contamination(docs: DataFrame, items: DataFrame, share: int = 20, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None, **options) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of any window; a document is
    contaminated if it has hits and they are at least one in ``share`` of its
    words.  Null and empty texts have no words; null, empty and repeated items
    add nothing; items without an id hit words but are not counted.  Rows that
    repeat an id are judged each by its own text.  Extra columns are not read.
    An empty corpus gives no rows, an empty benchmark no hits.  With an ``index``
    of the corpus, built before, ``docs`` is not read; one that is built for this
    call alone goes when its matches are found.
    """
    built = index or build_index(docs, id_col, text_col)
    documents = built.documents if index else written(built.documents, "documents")
    matches, owners = phrase_matches(built, items, **options)
    if not index:
        remove(built.rows.sparkSession, built.path)
    spans = matches.select("uid", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    so_far = Window.partitionBy("uid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(so_far), F.lit(0))))
    hits = spans.withColumn("fresh", fresh).groupBy("uid").agg(F.sum("fresh").alias("n_hit"))
    items_of = matches.select("uid", "window_id").distinct().join(owners, "window_id").select("uid", "item").distinct()
    lists = items_of.groupBy("uid").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    out = documents.join(hits, "uid", "left").join(lists, "uid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))
