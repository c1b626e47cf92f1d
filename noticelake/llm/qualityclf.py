"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are fitted level by level on binned features of a bounded labelled sample
and flattened into arrays; tasks traverse all trees at once with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.textstats import MEASURES, labelled_sample, statistics

#: The measures and two sizes, as SQL over the counts of a text.
FEATURES = MEASURES | {"log_words": "ln(1 + n_words)", "log_lines": "ln(1 + n_lines)"}


@dataclass(frozen=True)
class Forest:
    """Node k of any tree: rows with feature[k] <= threshold[k] go to left[k], the rest to left[k] + 1; a leaf leads to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    leaf: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[at]] > self.threshold[at]
            at = np.where(self.leaf[at], at, self.left[at] + right)
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least_weight: float = 2.0) -> Forest:
    """Log-loss boosting over histograms; without rows every score is one half."""
    n, width = x.shape
    roots, feature, threshold, left, leaf, value = [], [], [], [], [], []

    def node() -> int:
        for column, empty in ((feature, 0), (threshold, 0.0), (left, 0), (leaf, True), (value, 0.0)):
            column.append(empty)
        return len(feature) - 1

    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, width), int)
    offsets = np.arange(width) * bins
    raw = np.full(n, start)
    for _ in range(trees if n else 1):
        p = 1 / (1 + np.exp(-raw))
        slope, bend = y - p, p * (1 - p)
        root = node()
        roots.append(root)
        at, level = np.full(n, root), [root]
        for _ in range(depth):
            grown = []
            for k in level:
                rows = np.flatnonzero(at == k)
                flat = (binned[rows] + offsets).ravel()
                g, h = (np.bincount(flat, np.repeat(w[rows], width), width * bins).reshape(width, bins).cumsum(axis=1) for w in (slope, bend))
                total_g, total_h = g[0, -1], h[0, -1]
                g, h = g[:, :-1], h[:, :-1]
                gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
                gain[(h < least_weight) | (total_h - h < least_weight)] = 0
                for j, e in enumerate(edges):
                    gain[j, len(e) :] = 0
                j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, cut] <= 1e-6:
                    continue
                first, second = node(), node()
                feature[k], threshold[k], left[k], leaf[k] = int(j), float(edges[j][cut]), first, False
                at[rows] = np.where(binned[rows, j] > cut, second, first)
                grown += [first, second]
            level = grown
        for k in np.unique(at):
            rows = at == k
            value[k] = float(rate * slope[rows].sum() / (bend[rows].sum() + ridge))
        raw += np.array(value)[at]
    return Forest(np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(leaf), np.array(value), depth, start)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", may_learn: str = "true", most_rows: int = 20_000, **forest) -> tuple[DataFrame, Forest]:
    """(rows, forest): doc_id, its may_learn flag and score of every row of ``docs``.

    ``may_learn`` is SQL over doc_id that says which labels may be used; of these
    at most ``most_rows`` (chosen by hash of the id) fit the trees.  Scores
    use statistics of the whole text only, counted once, where it lies.  Null
    texts score as empty ones; a null id is scored and teaches nothing; rows that
    repeat an id are scored each; where an id has several labels the largest
    counts; no labels give one half throughout.  No rows give none.  Other columns
    are not read.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label"))
    x, y = labelled_sample(source, known, most_rows, may_learn, FEATURES)
    model = fit_forest(x, y, **forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(model.score(x))], ["doc_id", "may_learn", "score"])

    kind = source.schema["doc_id"].dataType.simpleString()
    stats = statistics(source, keep=("doc_id",)).select("doc_id", F.expr(may_learn).alias("may_learn"), *(F.expr(sql).cast("double").alias(name) for name, sql in FEATURES.items()))
    return stats.mapInArrow(run, f"doc_id {kind}, may_learn boolean, score double"), model
