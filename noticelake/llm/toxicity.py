"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: case, homoglyphs, accents, and digits or symbols that
stand for letters inside a word.  The lexicon (words and word beginnings with
log-odds weights, and exception phrases that excuse them) and the normalisation
by length are learned from a bounded labelled sample.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import hash_sample, written

#: Characters that show nothing and may hide in a word.
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Letters of other scripts that look like Latin ones, and Latin letters that do not decompose.
HOMOGLYPHS = str.maketrans(
    {
        **{"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ԝ": "w", "х": "x", "у": "y"},
        **{"α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ω": "w", "χ": "x"},
        **{"ø": "o", "ł": "l", "đ": "d", "ı": "i", "æ": "ae", "œ": "oe"},
        **dict.fromkeys(UNSEEN),
    }
)
#: Digits and symbols that stand for letters in a word, and those that end a word or sentence as often.
STAND_INS = "0134578@$!|"
STOPS = "!|"
_LETTERS = str.maketrans(STAND_INS, "oieastbasil")
_MASKED = re.compile(f"[{STAND_INS}][a-z]")
_RUN = re.compile(f"[a-z{STAND_INS}]++")
_ENDED = re.compile(f"[a-z][0134578@$]")
_WORD = re.compile("[^\\W\\d_]+")
_ACCENTS = re.compile("[\u0300-\u036f]+")
_KEEP = bytes(b if 97 <= b <= 122 else 32 for b in range(256))


def _unmask(run: re.Match) -> str:
    """Letters for what stands for them, up to the run's last letter."""
    core = run[0].rstrip(STAND_INS)
    return core.translate(_LETTERS) + run[0][len(core) :]


def _whole(run: re.Match) -> str:
    """The run with letters up to its end where a stand-in ends it, else nothing."""
    word = run[0].rstrip(STOPS)
    return word.translate(_LETTERS) if word[-1:] in STAND_INS and word.rstrip(STAND_INS) else ""


def fold(text: str | None) -> str:
    """Lower-case words with one space before, between and after; no words give one space.

    Accented words keep their accents, which tell words of some languages apart,
    and come again without them behind all words and one more space.  There too
    come words with the letters that digits and symbols at their end may stand for.
    """
    text = (text or "").lower()
    if not text.isascii():
        text = text.translate(HOMOGLYPHS)
    ended = [_whole(run) for run in _RUN.finditer(text)] if _ENDED.search(text) else []
    if _MASKED.search(text):
        text = _RUN.sub(_unmask, text)
    if text.isascii():
        words, again = text.encode().translate(_KEEP).decode().split(), []
    else:
        words = _WORD.findall(unicodedata.normalize("NFC", text))
        again = [w for w in (_ACCENTS.sub("", unicodedata.normalize("NFKD", x)) for x in words if not x.isascii()) if w.isascii()]
    again += filter(None, ended)
    return " ".join(["", *words, "", *again, ""]) if again else " ".join(["", *words, ""]) if words else " "


def count_words(folded: str) -> int:
    return len(folded.partition("  ")[0].split())


@dataclass(frozen=True)
class Lexicon:
    """Patterns with weights; ``" word "`` matches the word, ``" word"`` every word that begins so.

    A word counts once, with its heaviest pattern (an accented one once more
    without accents), unless it lies in an exception phrase.  score = logistic(intercept + by_weight * log1p(weight)
    + by_length * log1p(words)).
    """

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    intercept: float = -4.0
    by_weight: float = 4.0
    by_length: float = -0.2

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    @cached_property
    def automaton(self):
        found = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            found.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        found.make_automaton()
        return found

    def weight(self, folded: str) -> float:
        """The summed weight of the words of a folded text that no exception excuses."""
        if not self.weights:
            return 0.0
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (n, weight) in self.automaton.iter(folded):
            start = end - n + 1
            if weight is None:
                excused.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if excused:
            starts = sorted(best)
            for start, end in excused:
                for at in starts[bisect_left(starts, start) : bisect_left(starts, end)]:
                    best.pop(at, None)
        return math.fsum(best.values())

    def score(self, weight, words):
        return 1 / (1 + np.exp(-(self.intercept + self.by_weight * np.log1p(weight) + self.by_length * np.log1p(words))))


def _found_in(texts: DataFrame, patterns_of, name: str) -> DataFrame:
    """(pattern, name): in how many surroundings the texts have each pattern.

    ``patterns_of`` gives a word's and its follower's patterns.  A text counts
    with the words around its first use, so that copies of it add nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[str, int]] = set()  # of a task's texts, whose number is bounded as the sample is
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = ["", *fold(text).split(), "", ""]
                first: dict[str, int] = {}
                for i in range(1, len(words) - 2):
                    for pattern in patterns_of(words[i], words[i + 1]):
                        if pattern not in first:
                            first[pattern] = zlib.crc32(f"{words[i - 1]} {words[i + 2 if ' ' in pattern.strip() else i + 1]}".encode())
                told.update(first.items())
        found = list(told)
        for k in range(0, len(found), 100_000):
            part = found[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), pa.array([a for _, a in part], pa.int64())], ["pattern", "around"])

    dealt = texts.select("text").repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, "pattern string, around long").distinct().groupBy("pattern").agg(F.count("*").alias(name))


def _compared(toxic: DataFrame, clean: DataFrame, patterns_of, least: float) -> dict[str, tuple[int, int]]:
    """Patterns found in ``least`` surroundings of toxic texts, or more, with their finds there and in clean texts.

    Clean texts, which hold most of the patterns, are searched for these alone.
    As all texts are of a bounded sample, so are the patterns.
    """
    often = {r.pattern: r.t for r in _found_in(toxic, patterns_of, "t").where(F.col("t") >= least).collect()}
    if not often:
        return {}
    wanted = toxic.sparkSession.sparkContext.broadcast(frozenset(often))
    also = {r.pattern: r.c for r in _found_in(clean, lambda a, b: filter(wanted.value.__contains__, patterns_of(a, b)), "c").collect()}
    return {p: (t, also.get(p, 0)) for p, t in often.items()}


def learn_lexicon(sample: DataFrame, least_finds: int = 3, least_share: float = 0.003, least_odds: float = 6.0, prefixes: tuple[int, int] = (4, 8)) -> Lexicon:
    """A lexicon from (label int, text) rows, which must be a bounded sample.

    Patterns that are ``least_odds`` times as frequent in toxic texts, found
    there in ``least_finds`` surroundings and ``least_share`` of the texts, weigh their log-odds; of a beginning
    and its continuations only what adds is kept.  Two words with such a word
    that clean texts hold half as often as toxic ones, or more often, are an
    exception.  All that qualify are taken.
    """
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0) + 1, sizes.get(0, 0) + 1
    if min(n_toxic, n_clean) == 1:
        return Lexicon({})
    toxic, clean = sample.where("label = 1"), sample.where("label = 0")
    shortest, longest = prefixes
    words = _compared(toxic, clean, lambda w, _: (f" {w} ", *(f" {w[:k]}" for k in range(shortest, min(longest, len(w)) + 1))), max(least_finds, least_share * n_toxic))
    odds = {p: (t + 0.1) / n_toxic / ((c + 0.5) / n_clean) for p, (t, c) in words.items()}
    found = {p: math.log(x) for p, x in odds.items() if x >= least_odds}
    weights = {p: w for p, w in found.items() if not any(found.get(p[:k], 0) >= w - 0.7 for k in range(shortest + 1, len(p)))}
    if not weights:
        return Lexicon({})
    draft = Lexicon(weights)

    def around_hits(word: str, follower: str) -> tuple[str, ...]:
        hit = draft.weight(f" {word} ") or (follower and draft.weight(f" {follower} "))
        return (f" {word} {follower} ",) if hit and follower else ()

    in_clean = {r.pattern: r.c for r in _found_in(clean, around_hits, "c").where(F.col("c") >= least_finds).collect()}
    in_toxic = {r.pattern: r.t for r in _found_in(toxic, around_hits, "t").collect()} if in_clean else {}
    exceptions = frozenset(p.strip() for p, c in in_clean.items() if c / n_clean >= 0.5 * in_toxic.get(p, 0) / n_toxic)
    return _calibrated(Lexicon(weights, exceptions), sample)


def _weighed(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...]) -> DataFrame:
    """The columns to keep, and weight and words of each whole text (the last column)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "weight double", "words long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = shared.value.weight
        for batch in batches:
            folded = (fold(t) for t in batch.column(len(keep)).to_pylist())
            found = [(weigh(f), count_words(f)) for f in folded]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([w for w, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], [*keep, "weight", "words"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def _calibrated(lexicon: Lexicon, sample: DataFrame, ridge: float = 1e-3, rounds: int = 40) -> Lexicon:
    """The lexicon with its intercept and slopes fitted to the sample by Newton steps of logistic regression."""
    rows = np.array([tuple(r) for r in _weighed(sample, lexicon, ("label",)).collect()], float)
    y, x = rows[:, 0], np.column_stack([np.ones(len(rows)), np.log1p(rows[:, 1]), np.log1p(rows[:, 2])])
    b, penalty = np.zeros(3), ridge * len(rows) * np.diag([1e-3, 1.0, 1.0]) / 10
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ b)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(3), x.T @ (y - p) - penalty @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return Lexicon(lexicon.weights, lexicon.exceptions, *map(float, b))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", may_learn: str = "true", most_rows: int = 12_000, **lexicon) -> tuple[DataFrame, Lexicon]:
    """(rows, lexicon): doc_id, weight, words and score (0 to 1) of every row of ``docs``.

    ``may_learn`` is SQL over doc_id that says which labels may be used.  Of
    these at most ``most_rows`` are used, half of them toxic where there are as
    many (chosen by hash of the id).  Scores use the whole text only.
    Null and empty texts have weight 0; a null id is scored and teaches nothing;
    rows that repeat an id are scored each; where an id has several labels the
    largest counts, and where it has several texts the least teaches; without both
    kinds of label the default slopes score an empty lexicon.  No rows give none.
    Other columns are not read.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(may_learn).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = [hash_sample(known.where(F.col("label") == k), "doc_id", most_rows // 2) for k in (0, 1)]
    chosen = written(picked[0].unionByName(picked[1]), "chosen")
    # one text of each id: copies of an id, however many, fall together before they are shuffled
    texts = source.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    sample = written(texts.select("label", "text"), "sample")
    lexicon = learn_lexicon(sample, **lexicon)
    # the sample holds toxic texts more often than the labels do
    there, here = ({r.label: r.n for r in x.groupBy("label").agg(F.count("*").alias("n")).collect()} for x in (known, sample))
    shift = math.log(there[1] / there[0] * here[0] / here[1]) if min(len(there), len(here)) == 2 else 0.0
    lexicon = replace(lexicon, intercept=lexicon.intercept + shift)
    scored = _weighed(source, lexicon, ("doc_id",))
    line = F.lit(lexicon.intercept) + lexicon.by_weight * F.log1p("weight") + lexicon.by_length * F.log1p("words")
    return scored.withColumn("score", 1 / (1 + F.exp(-line))), lexicon
