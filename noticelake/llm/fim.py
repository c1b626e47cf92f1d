"""Fill-in-the-middle rearrangement as relations of units.

A document's units (lines, unless another pattern is given) are matched and
posexploded to rows of their lengths, running sums say where each one ends, and the
cuts that a document asks for, by ordinals of units, meet those rows.  What comes
back to a document is two offsets, by which its text is cut.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A line with its break, or what stands behind the last one.
LINES = r"[^\n]*\n|[^\n]+"
#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def _drawn(ident: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers that the seed and an id fix."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _any_mark(marks: tuple[str, str, str]) -> str:
    """A pattern of the marks, which must be such that no text around one makes another."""
    first = marks[0][:1]
    if len(set(marks)) < 3 or any(m[:1] != first or m.count(first) != 1 or len(m) < 2 for m in marks):
        raise ValueError("the marks must differ, begin with one character and hold it nowhere else")
    return "|".join(rf"\Q{m}\E" for m in marks)


def rearranged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row.

    A document of n units is cut behind two of n + 1 places that ``seed`` and its
    id fix.  ``rate`` percent of the documents change their form, ``spm`` percent
    of these to suffix, prefix, middle (spm), the others to prefix, suffix, middle
    (psm).  The rest, empty and null texts (which are as empty ones) and texts that hold a mark
    are plain: the output is the text, the two lengths are null.  Lengths
    are code points.  Matches of ``unit`` should follow each other without gaps; gaps only
    move the cuts.  Rows that repeat an id are cut each; a null id draws like an
    empty one.  Other columns are not read.  No rows give none.

    Texts are moved once, by a number of their row; units, cuts and offsets then
    lie where their text does.
    """
    pattern = _any_mark(marks)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.monotonically_increasing_id().alias("row")).repartition("row")

    lengths = F.transform(F.regexp_extract_all("text", F.lit(unit), F.lit(0)), F.char_length)
    units = keyed.select("row", "id", F.posexplode_outer(lengths).alias("at", "chars"))
    # the id, which the row fixes, is named in every branch, so that all read one exchange
    so_far = Window.partitionBy("row", "id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = units.select("row", "id", (F.col("at") + 1).alias("ordinal"), F.sum("chars").over(so_far).alias("end"))

    first, second, _, _ = _drawn(F.col("id"), seed)
    n = F.regexp_count("text", F.lit(unit)).cast("long")
    asked = keyed.select(F.col("row").alias("of_row"), n.alias("n"), first.alias("h1"), second.alias("h2"))
    asked = asked.select("of_row", "n", (F.col("h1") % (F.col("n") + 1)).alias("a"), (F.col("h2") % (F.col("n") + 1)).alias("b"))
    asked = asked.select("of_row", "n", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), F.array("a", "b").alias("cuts"))
    # a document's two requests stay one row: matched by its row, then by ordinals, so that nothing is moved again
    met = ends.join(asked.hint("shuffle_hash"), (F.col("row") == F.col("of_row")) & (F.array_contains("cuts", F.col("ordinal").cast("long")) | F.coalesce(F.col("ordinal") == 1, F.lit(True))))
    at = lambda cut: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(cut), F.col("end"))), F.lit(0)).cast("long")
    offsets = met.groupBy("row", "id").agg(F.max("n").alias("n"), at("low").alias("prefix_end"), at("high").alias("middle_end")).drop("id")

    _, _, third, fourth = _drawn(F.col("id"), seed)
    plain = (F.col("text") == "") | F.col("text").rlike(pattern) | (third % 100 >= rate)
    form = F.when(plain, "plain").when(fourth % 100 < spm, "spm").otherwise("psm")
    told = keyed.withColumn("form", form).join(offsets.hint("shuffle_hash"), "row")  # narrow rows are hashed, texts are not sorted
    prefix = F.substring("text", F.lit(1), F.col("prefix_end"))
    middle = F.substring("text", F.col("prefix_end") + 1, F.col("middle_end") - F.col("prefix_end"))
    suffix = F.substring("text", F.col("middle_end") + 1, F.char_length("text"))
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    cut = F.col("form") != "plain"
    return told.select("id", "n", "form", F.when(cut, F.col("prefix_end")).alias("prefix_chars"), F.when(cut, F.col("middle_end") - F.col("prefix_end")).alias("middle_chars"), output.alias("output"))


def restored(output: Column | str, form: Column | str, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that a rearranged document was made of; null for an output that no text of that form gives."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, _any_mark(marks), -1)
    part = lambda k: F.get(parts, F.lit(k))
    whole = F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1)))
    return F.when(form == "plain", output).when((F.size(parts) == 4) & (part(0) == ""), whole)


def restored_text(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """:func:`restored` of one document, for readers of packed files."""
    if form == "plain":
        return output
    _, first, second, middle = re.split("|".join(map(re.escape, marks)), output)
    return first + middle + second if form == "psm" else second + middle + first
