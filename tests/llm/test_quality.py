import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noticelake.llm import textstats
from noticelake.llm.qualityclf import classify, fit_forest
from noticelake.llm.qualityrules import BASE_FAILED, keep_good, learn_rules, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", " ", "  ", "\n", "\t", "\x1f", "\x85", "#", "a b c", "👍", "\r"])).map("".join))
def test_counts_match_a_plain_count(text):
    assert textstats.statistics_of(text.encode())[:5] == brute(text)


def test_texts_with_very_many_words(monkeypatch):
    text = " ".join(random.Random(1).choice("abcdefgh") for _ in range(200))
    want = textstats.statistics_of(text.encode())
    monkeypatch.setattr(textstats, "WIDE", 3)
    assert textstats.statistics_of(text.encode()) == want and want[:5] == brute(text)


def test_learned_rules_separate_what_can_be_separated():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 1] <= 0.5) | (x[:, 2] > 0.95)
    found = learn_rules(x, bad, ["a", "b", "c"])
    y = rng.random((4000, 3))
    want = (y[:, 0] > 0.7) & (y[:, 1] <= 0.5) | (y[:, 2] > 0.95)
    assert (found.rejects(y, ["a", "b", "c"]) == want).mean() > 0.98
    assert all(1 <= len(r) <= 4 for r in found.rules)
    noise = learn_rules(x, rng.random(4000) < 0.1, ["a", "b", "c"])
    assert noise.rejects(y, ["a", "b", "c"]).mean() < 0.02
    assert learn_rules(np.zeros((0, 3)), np.zeros(0, bool), ["a", "b", "c"]).rules == ()


def corpus(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(55, 90))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + rng.choice(["***", "%%%"]) if bad else w for w in words)))
        if i % 3:
            labels.append((i, int(not bad), 0))
    rows += [(500, None), (501, ""), (502, "one two"), (None, rows[1][1]), (1, rows[1][1]), (503, "a b c " * 40), (504, rows[4][1])]
    docs = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], "doc_id long, text string, n_words int, base_failed string, label int")
    return rows, docs, spark.createDataFrame([*labels, (1, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")


def test_rules_over_a_table(spark):
    rows, docs, labels = corpus(spark)
    found, rules = quality_rules(docs, labels)
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in found.collect())
    want = []
    for i, t in rows:
        n, *rest, rep = brute(t)
        failed = n < 50 or 100 * rep > 50 * n
        want.append((str(i), n, *rest, rep, failed, not failed and "***" not in t and "%%%" not in t))
    assert got == sorted(want)
    assert "CASE WHEN" in rules.verdict()._jc.toString() and "symbols_per_word" in str(rules)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if w[-1])


def test_rules_without_labels_or_rows(spark):
    rows, docs, labels = corpus(spark)
    found, rules = quality_rules(docs, labels.where("false"))
    assert rules.rules == () and all(r.kept == (not r.base_failed) for r in found.collect())
    assert quality_rules(docs.where("false"), labels)[0].collect() == [] and BASE_FAILED


def test_forest_traversal_matches_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    f = fit_forest(x, y, trees=30)
    z = rng.normal(size=(300, 4))

    def walk(row):
        total = f.start
        for k in f.roots:
            while not f.leaf[k]:
                k = f.left[k] + (row[f.feature[k]] > f.threshold[k])
            total += f.value[k]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(f.score(z), [walk(r) for r in z])
    assert ((f.score(z) >= 0.5) == ((z[:, 0] > 0) ^ (z[:, 1] > 0.3))).mean() > 0.9
    assert fit_forest(np.zeros((0, 4)), np.zeros(0)).score(z).tolist() == [0.5] * 300


def test_classifier_over_a_table(spark):
    rows, docs, labels = corpus(spark)
    rule = "not (crc32(cast(doc_id as string)) % 4 = 2)"
    found, _ = classify(docs, labels, may_learn=rule)
    got = found.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 60 and all((r.score >= 0.7) == (r.doc_id % 4 != 0) and not r.may_learn for r in held)
    none, _ = classify(docs, labels.where("false"))
    assert {r.score for r in none.collect()} == {0.5}
    assert classify(docs.where("false"), labels)[0].collect() == []
    long = docs.limit(1).selectExpr("999L as doc_id", "repeat(concat(text, ' '), 3000) as text")
    assert 0 <= classify(long, labels)[0].first().score <= 1 and quality_rules(long, labels)[0].first().n_words > 150_000


def test_an_id_that_many_rows_share_teaches_once(spark):
    rows = [(i, f"w{i} " * 60) for i in range(10)] + [(3, f"other {k} " * 60) for k in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(3, None, 0)], "doc_id long, label int, toxic int")
    x, y = textstats.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, 100)
    assert len(x) == 10 and y.tolist() == [0, 1] * 5
    x, y = textstats.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, 6)
    assert len(x) <= 6


@pytest.mark.parametrize("flip", [0, 1])
def test_held_out_labels_change_nothing(spark, flip):
    rows, docs, labels = corpus(spark)
    held = "crc32(cast(doc_id as string)) % 4 = 2"
    other = labels.selectExpr("doc_id", f"case when {held} then {flip} else quality end as quality")
    a, b = (sorted((str(r.doc_id), r.score) for r in classify(docs, x, may_learn=f"not ({held})")[0].collect()) for x in (labels, other))
    assert a == b
