"""Quality rules: decision lists learned by sequential covering, run as Spark conditional expressions.

Rules that reject are grown one threshold at a time on one part of a labelled
sample, pruned on the other, and kept while they are precise there; what a rule
covers is set aside for the next.  The list becomes one ``CASE WHEN`` column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.textstats import COUNTS, MEASURES, labelled_sample, statistics, with_measures


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
        column = x[:, names.index(self.feature)]
        return column > self.threshold if self.above else column <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules that reject, in order; what none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rejects(self, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([c.holds(x, names) for c in rule])
        return out

    def verdict(self) -> Column:
        """True where no rule rejects."""
        out = None
        for rule in self.rules:
            covers = F.lit(True)
            for c in rule:
                covers = covers & c.column()
            out = F.when(covers, False) if out is None else out.when(covers, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, rule)) for rule in self.rules) or "keep all"


def _best_condition(x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> tuple[float, Condition | None]:
    """The threshold with the largest information gain for the bad rows, in the middle of its gap."""
    whole, best, found = bad.mean(), 0.0, None
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        values, hits = x[order, j], np.cumsum(bad[order])
        cuts = np.flatnonzero(values[1:] > values[:-1])
        if not len(cuts):
            continue
        for above in (True, False):
            p = hits[-1] - hits[cuts] if above else hits[cuts]
            n = len(values) - 1 - cuts if above else cuts + 1
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / n) - np.log2(whole)), 0)
            k = int(gain.argmax())
            if gain[k] > best + 1e-9:
                best, found = float(gain[k]), Condition(name, above, float((values[cuts[k]] + values[cuts[k] + 1]) / 2))
    return best, found


def learn_rules(x: np.ndarray, bad: np.ndarray, names: Sequence[str], most_rules: int = 12, most_conditions: int = 4, least_precision: float = 0.9, least_covered: int = 5, seed: int = 0) -> DecisionList:
    """Sequential covering with grown and pruned conjunctions; no bad rows give the empty list.

    A list has ``most_rules`` rules of ``most_conditions`` conditions at most, which keeps it legible and
    bounds the expression that is made of it; no row is left out for either.
    """
    growing = np.random.default_rng(seed).random(len(x)) < 2 / 3
    left, rules = np.ones(len(x), bool), []
    while len(rules) < most_rules and (bad & left & growing).any():
        inside, rule = left & growing, []
        while len(rule) < most_conditions and not bad[inside].all():
            _, condition = _best_condition(x[inside], bad[inside], names)
            if condition is None:
                break
            rule.append(condition)
            inside &= condition.holds(x, names)
        if not rule:
            break

        def worth(k, rule=rule):
            covered = left & ~growing & np.logical_and.reduce([c.holds(x, names) for c in rule[:k]])
            p = int((bad & covered).sum())
            return (2 * p - int(covered.sum())) / (int(covered.sum()) + 2), -k

        rule = rule[: max(range(1, len(rule) + 1), key=worth)]
        covered = left & np.logical_and.reduce([c.holds(x, names) for c in rule])
        if covered.sum() < least_covered or bad[covered].mean() < least_precision:
            break
        rules.append(tuple(rule))
        left &= ~covered
    return DecisionList(tuple(rules))


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 20_000) -> DecisionList:
    """The list learned from at most ``most_rows`` labelled rows (chosen by hash of the id), of these the ones that pass the base rules."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label"))
    x, label = labelled_sample(source, known, most_rows, only=f"not ({BASE_FAILED})")
    return learn_rules(x, label == 0, list(MEASURES))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 20_000) -> tuple[DataFrame, DecisionList]:
    """(rows, rules): each row's id, counts, base_failed and kept, and the list that decided.

    The list is learned from a bounded sample and judges all rows, whose whole
    texts are counted once, where they lie.  A null text counts as empty and fails
    the base; a row without an id is judged but teaches nothing; rows that repeat
    an id are judged each; where an id has several labels the largest counts.
    Without labels only the base rules reject.  No rows give none.  Other columns
    are not read.
    """
    rules = learned(docs, labels, id_col, text_col, label_col, most_rows)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    stats = with_measures(statistics(source, keep=("doc_id",))).withColumn("base_failed", F.expr(BASE_FAILED))
    return stats.select(F.col("doc_id").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed") & rules.verdict()).alias("kept")), rules


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were.

    Counts are made beside each text, once, so that nothing is joined by id: rows
    without an id, or with a repeated one, are judged by their own text, and
    columns may have any names.
    """
    rules = learned(docs, labels, id_col, text_col, **options)
    safe = docs.toDF(*(f"__c{i}" for i in range(len(docs.columns))))
    counted = with_measures(statistics(safe, safe.columns[docs.columns.index(text_col)], keep=tuple(safe.columns)))
    good = counted.where(~F.expr(BASE_FAILED) & rules.verdict())
    return good.select(*(F.col(s).alias(c) for s, c in zip(safe.columns, docs.columns, strict=True)))
