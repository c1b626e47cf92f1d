"""Statistics of whole texts, one pass each in Arrow batches; the inputs of the quality rules and the quality classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import hash_sample

#: The symbols that the base statistics count.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_stops")
_SPACE = np.zeros(256, np.int64)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1
#: A word's number takes 21 bits of a window's key.
WIDE = 1 << 21


def _inside(hit: np.ndarray, n_words: int) -> int:
    """Words of the 3-word windows that are hit."""
    inside = np.zeros(n_words, bool)
    for k in range(3):
        inside[k : n_words - 2 + k] |= hit
    return int(inside.sum())


def repeated_words(numbers: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more, the first find included."""
    if len(numbers) < 4:
        return 0
    windows = (numbers[:-2] << 42) | (numbers[1:-1] << 21) | numbers[2:]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    return _inside(np.isin(windows, twice), len(numbers))


def statistics_of(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of a UTF-8 text; a null text is as an empty one."""
    text = text or b""
    words = text.split()
    bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    names: dict[bytes, int] = {}
    numbers = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    if len(names) > WIDE:  # numbers no longer fit a key: give windows numbers of their own
        seen: dict[tuple[bytes, ...], int] = {}
        windows = [seen.setdefault(w, len(seen)) for w in zip(words, words[1:], words[2:], strict=False)]
        repeated = _inside(np.bincount(windows)[windows] > 1, len(words))
    else:
        repeated = repeated_words(numbers)
    lines = text.split(b"\n")
    spoken = [x for x in lines if x.strip()]
    points = len(text) - int(bytes_of[128:192].sum())
    return (
        len(words),
        points - int(bytes_of @ _SPACE),
        int(bytes_of @ _SYMBOL),
        len(spoken) - len(set(spoken)),
        repeated,
        len(lines),
        len(names),
        int(bytes_of[65:91].sum()),
        int(bytes_of[48:58].sum()),
        int(bytes_of[[33, 63]].sum()),
        int(bytes_of[[44, 46]].sum()),
    )


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """COUNTS of each row's whole text beside the columns to keep."""
    fields = [docs.schema[c] for c in keep]
    columns = [F.col(f"`{c}`") for c in keep]
    at = keep.index(text_col) if text_col in keep else len(keep)
    if at == len(keep):
        columns.append(F.col(f"`{text_col}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics_of(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            counts = np.array(found, np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(counts[:, i]) for i in range(len(COUNTS)))], [*keep, *COUNTS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} long" for c in COUNTS)])
    return docs.select(*columns).mapInArrow(run, schema)


#: Length-free measures of a text, as SQL over COUNTS.
MEASURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / n_lines",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digits_per_word": "n_digits / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
}


def with_measures(stats: DataFrame) -> DataFrame:
    """Adds MEASURES (double) to the counts."""
    return stats.select("*", *(F.expr(sql).cast("double").alias(name) for name, sql in MEASURES.items()))


def labelled_sample(docs: DataFrame, labels: DataFrame, most_rows: int, may_learn: str = "true", features: dict[str, str] | None = None, only: str = "true") -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) that a model is fitted on: at most ``most_rows`` labelled ids, chosen by hash of the id.

    ``docs`` has doc_id and text, ``labels`` doc_id and label; ``may_learn`` is SQL
    over doc_id, ``only`` SQL over COUNTS.  The ids are chosen before any text is
    counted, so only their texts are.  Null ids and labels teach nothing; where an
    id has several labels the largest counts, where it has several texts the one
    with the least features.
    """
    features = MEASURES if features is None else features
    known = labels.where("doc_id is not null and label is not null").where(may_learn).groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    chosen = hash_sample(known, "doc_id", most_rows)  # at most most_rows of two numbers each, so they may be sent to every task
    counted = statistics(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text"), keep=("doc_id", "label")).where(only)
    measured = counted.select("doc_id", "label", F.struct(*(F.expr(sql).cast("double").alias(name) for name, sql in features.items())).alias("x"))
    rows = measured.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x")).orderBy("doc_id").select("label", "x.*").collect()
    found = np.array([tuple(r) for r in rows], float).reshape(-1, 1 + len(features))
    return found[:, 1:], found[:, 0].astype(int)
