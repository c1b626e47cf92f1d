"""Licence scans: normalised text against licence templates by the Dice coefficient of word bigrams.

Each template is laid against a text wherever enough of their bigrams agree, and
compared with the stretches of the text that begin with one such place and end with the same or
another one, so that licence files as well as notices inside other text, over several
paragraphs or within a line, with words put in or left out, and as often as a text holds them,
are found.  Only templates of which a text holds as many bigrams as their size asks
for the wanted similarity are compared.
Texts without any of the words that a similar stretch must hold are left out
before their bigrams are built.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import written

#: Fixed values: (licence, public notice).  The public licence texts and their standard headers are files beside this module.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)
FOLDER = Path(__file__).parent / "licenses"


@cache
def templates() -> tuple[tuple[str, str], ...]:
    """(licence, text) of every template: a fixed, small catalogue."""
    files = sorted(FOLDER.glob("*.txt"))
    return (*NOTICES, *((f.stem.removesuffix(".header"), f.read_text(encoding="utf-8")) for f in files))


def words_of(text: str) -> list[str]:
    """Lower-case words of a-z and 0-9."""
    return re.findall("[a-z0-9]+", text.lower())


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def least_size(threshold: float, n: int) -> int:
    """The fewest bigrams of a stretch that can be similar to a template of n."""
    return max(1, math.ceil(threshold / (2 - threshold) * n - 1e-9))


def most_size(threshold: float, n: int) -> int:
    """The most bigrams of a stretch that can be similar to a template of n: it holds all of the template and other words in between."""
    return math.floor((2 / threshold - 1) * n + 1e-9)


def least_votes(n: int) -> int:
    """The fewest bigrams that agree on a place where a template of n may begin or end: a sixteenth of it, and two where it has two."""
    return min(n, max(2, -(-n // 16)))


def telling_words(text: str, threshold: float, common: Counter | None = None) -> set[str]:
    """Words of a template of which every stretch that is similar enough holds one.

    Such a stretch shares all but a known number of the template's bigrams, so it
    holds a word of any set that touches more bigrams than that; words that few
    templates have (``common`` counts them) are taken first, and long ones among these.
    """
    words = words_of(text)
    n = len(words) - 1
    missing = n - math.ceil(threshold / 2 * (least_size(threshold, n) + n) - 1e-9)
    chosen: set[str] = set()
    for word in sorted(set(words), key=lambda w: ((common or {}).get(w, 0), -len(w), w)):
        chosen.add(word)
        if sum(a in chosen or b in chosen for a, b in zip(words, words[1:], strict=False)) > missing:
            break
    return chosen


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: tuple[tuple[str, str], ...] | None = None, threshold: float = 0.8) -> DataFrame:
    """(id, start, length, template, license, dice) of every stretch of a text that is similar to a template, with a Dice coefficient of at least ``threshold``.

    A template lies at an offset if :func:`least_votes` of the text's bigrams stand as far from there
    as their first find in the template does from the template's start.  A stretch begins where a
    template at one offset does and ends where one at the same or another offset does, cut at the
    ends of the text; it begins at word ``start`` and has ``length`` bigrams, as few or many as can
    be similar at all.  Bigrams count as often as they occur.  Of stretches of one template that overlap
    those count that no overlapping one is better than: by Dice, then the earlier, then the
    shorter.  Null, empty and one-word texts match nothing; rows that repeat an id are
    scanned each and report each; a null id is reported as null.  No rows give
    none.  Other columns are not read.
    """
    spark, texts = docs.sparkSession, templates() if texts is None else texts
    grams = [bigrams_of(t) for _, t in texts]
    common = Counter(w for _, t in texts for w in set(words_of(t)))
    telling = sorted(set().union(*(telling_words(t, threshold, common) for (_, t), g in zip(texts, grams, strict=True) if g)))
    numbers: dict[str, int] = {}
    rows = []  # a row for each distinct bigram of each template
    for k, found in enumerate(grams):
        first: dict[str, int] = {}
        for place, g in enumerate(found):
            first.setdefault(g, place)
        rows += [(numbers.setdefault(g, len(numbers)), k, first[g], n) for g, n in Counter(found).items()]
    known = spark.createDataFrame(list(numbers.items()), "bigram string, number int")
    places = spark.createDataFrame(rows, "number int, template int, place int, times int")
    sizes = spark.createDataFrame([(k, name, len(g), least_size(threshold, len(g)), most_size(threshold, len(g)), least_votes(len(g))) for k, ((name, _), g) in enumerate(zip(texts, grams, strict=True))], "template int, license string, size int, least int, most int, agreed int")
    # all three are tables of the catalogue, whose size no corpus changes
    marks = F.array(*map(F.lit, telling))

    def bigrams(words: Column) -> Column:
        n = F.size(words) - 1
        pairs = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when((n > 0) & F.arrays_overlap(words, marks), pairs)

    # a text's words are bound once, and no filter passes the row's number to make them again
    told = docs.select(F.col(f"`{id_col}`").alias("id"), F.transform(F.array(_words(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))), bigrams)[0].alias("bigrams"), F.monotonically_increasing_id().alias("row"))
    every = told.select("row", "id", F.size("bigrams").alias("n"), F.posexplode("bigrams").alias("at", "bigram"))
    hits = written(every.join(F.broadcast(known), "bigram").select("row", "id", "n", "at", "number"), "licence-hits")
    # a similar stretch shares at least as many bigrams as it must have, so a text with fewer finds of a template is no match
    finds = hits.join(F.broadcast(places), "number").groupBy("row", "template").agg(F.count("*").alias("finds"))
    likely = finds.join(F.broadcast(sizes), "template").where("finds >= least").select("row", "template")
    near = hits.join(likely, "row").join(F.broadcast(places), ["number", "template"])
    near = written(near.select("row", "id", "n", "at", "number", "template", "place", "times"), "licence-near")
    votes = near.groupBy("row", "id", "n", "template", (F.col("at") - F.col("place")).alias("offset")).agg(F.count("*").alias("votes"))
    laid = votes.join(F.broadcast(sizes), "template").where("votes >= agreed").select("row", "id", "n", "template", "license", "size", "least", "most", "offset")
    laid = written(laid, "licence-places")
    # places of one template meet within blocks of its largest stretch, so that a text of many copies is no product of them
    ends = laid.select("row", "template", F.col("offset").alias("last"), F.explode(F.expr("array(floor(offset / most) - 1, floor(offset / most), floor(offset / most) + 1)")).alias("block"))
    spans = laid.withColumn("block", F.expr("floor(offset / most)")).join(ends, ["row", "template", "block"])
    spans = spans.withColumns({"start": F.greatest(F.lit(0), "offset"), "end": F.least("n", F.col("last") + F.col("size"))})
    stretch = ["row", "id", "template", "license", "size", "most", "start", "end"]
    spans = spans.where("end - start between least and most").select(*stretch).distinct()
    blocks = F.explode(F.expr("sequence(start div most, (end - 1) div most)")).alias("block")
    held = near.join(F.broadcast(sizes.select("template", "most")), "template").select("row", "template", "at", "number", "times", F.expr("at div most").alias("block"))
    inside = spans.select("*", blocks).join(held, ["row", "template", "block"]).where("at >= start and at < end")
    shared = inside.groupBy(*stretch, "number", "times").agg(F.count("*").alias("found")).groupBy(*stretch).agg(F.sum(F.least("found", "times")).alias("shared"))
    length = F.col("end") - F.col("start")
    scored = shared.withColumn("dice", 2 * F.col("shared") / (length + F.col("size"))).where(F.col("dice") >= threshold)
    scored = written(scored.select(*stretch, "dice"), "licence-stretches")
    mine, other = scored.select("*", blocks), scored.select("row", "template", F.col("start").alias("s"), F.col("end").alias("e"), F.col("dice").alias("d"), blocks)
    better = F.struct(-F.col("d"), F.col("s"), F.col("e")) < F.struct(-F.col("dice"), F.col("start"), F.col("end"))
    worse = mine.join(other, ["row", "template", "block"]).where("s < end and start < e").where(better).select("row", "template", "start", "end").distinct()
    kept = scored.join(worse, ["row", "template", "start", "end"], "left_anti")
    return kept.select("id", "start", length.alias("length"), "template", "license", "dice")
