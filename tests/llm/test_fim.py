"""Fill-in-the-middle against a plain version, and the way back."""

import hashlib
import re

import pytest

from noticelake.llm import fim

TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb\nc", "a\nb\nc\n", "ünï 😀\n中文\r\nend", "has <P> in it\nx", "<S", "x\n<M", "<P\n>", "word " * 30_000, "l\n" * 20_000, "\0\n\x0b\x85 q\n"]


def plainly(ident, text, seed=7, rate=100, spm=50, marks=fim.MARKS):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    p, s, m = marks
    if h4 % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return len(units), "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def through(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "clash", 5, "x") for i, t in rows], "doc_id long, text string, n string, row long, form string")
    found = fim.rearranged(docs, **options)
    marks = {"marks": options["marks"]} if "marks" in options else {}
    return found.withColumn("again", fim.restored("output", "form", **marks)).collect()


@pytest.mark.parametrize("options", [{}, {"seed": 3, "rate": 60, "spm": 0}, {"spm": 100, "marks": ("<|pre|>", "<|suf|>", "<|mid|>")}])
def test_like_the_plain_version(spark, options):
    rows = [(i, t) for k in range(5) for i, t in enumerate(TEXTS, 100 * k)] + [(None, "a\nb\nc\nd"), (None, "a\nb\nc\nd"), (7, "u\nv"), (7, "other\ntext\nhere")]
    got = through(spark, rows, **options)
    want = [(i, *plainly(i, t, **options)) for i, t in rows]
    assert sorted(((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted(want, key=str)
    assert sorted(r.again for r in got) == sorted(t or "" for _, t in rows)
    marks = {"marks": options["marks"]} if "marks" in options else {}
    assert all(fim.restored_text(r.output, r.form, **marks) == r.again for r in got)


def test_other_units_and_empty_table(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(k))) for k in range(40)]
    got = through(spark, rows, unit=r"\s*\S+")
    assert {r.id: r.n for r in got} == {k: k for k in range(40)}
    assert all(r.again == dict(rows)[r.id] for r in got)
    assert through(spark, []) == []


def test_a_foreign_output_restores_to_null(spark):
    rows = spark.createDataFrame([("<P>a<S>b", "psm"), ("q<S>a<P>b<M>c", "spm"), ("<P>a<S>b<M>c", "psm")], "o string, f string")
    assert [r[0] for r in rows.select(fim.restored("o", "f")).collect()] == [None, None, "acb"]


@pytest.mark.parametrize("marks", [("<P>", "<S>", "<S>"), ("<P>", "[S]", "<M>"), ("<<", "<S>", "<M>"), ("", "<S>", "<M>")])
def test_marks_that_may_be_mistaken_are_refused(spark, marks):
    with pytest.raises(ValueError, match="marks"):
        through(spark, [(1, "a")], marks=marks)


def test_texts_move_once(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    got = fim.rearranged(docs)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 2
    assert plan.count("Exchange hashpartitioning") - plan.count("], Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "Broadcast" not in plan
