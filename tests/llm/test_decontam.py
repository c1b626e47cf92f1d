import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noticelake.llm import decontam
from noticelake.llm.decontam import build_index, contamination, open_index, phrase_matches

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, size=13):
    out = []
    for d, t in docs:
        w, hit, seen = words(t), set(), set()
        for item, text in items:
            b = words(text)
            for k in range(max(1, len(b) - size + 1) if b else 0):
                win = b[k : k + size]
                for i in range(len(w) - len(win) + 1):
                    if w[i : i + len(win)] == win:
                        hit.update(range(i, i + len(win)))
                        seen.add(str(item))
        out.append((d, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "Été", "42", "x9", "naïve", "rare%d" % seed] + [f"w{i}" for i in range(15)]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.randrange(1, 40))) for i in range(20)] + [(50, "the"), (51, ""), (52, None), (53, "of of of"), (3, "of of of")]
    docs = []
    for i in range(60):
        cut = words(rng.choice(items)[1])
        a = rng.randrange(len(cut) + 1)
        docs.append((i, text(rng.randrange(0, 60)) + " " + " ".join(cut[a : a + rng.randrange(10, 30)]).upper().replace("É", "É") + " " + text(rng.randrange(0, 200))))
    docs += [(900, None), (901, ""), (902, "..."), (7, docs[7][1]), (7, "THE"), (903, "of " * 300)]
    return docs, items


@pytest.mark.parametrize("words", [1 << 20, 50])
def test_against_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", words)  # segments of many texts, and of few
    docs, items = made(5)
    docs.append((904, "of the " * 20_000 + (items[0][1] or "")))
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, term string")
    b = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, uid int")
    got = sorted(tuple(r) for r in contamination(d, b).collect())
    assert got == brute(docs, items)


def test_one_index_serves_any_benchmark(spark, tmp_path):
    docs, items = made(7)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    build_index(d, path=f"{tmp_path}/index")
    index = open_index(spark, f"{tmp_path}/index")
    got = {(r.term, r.id): r.places for r in index.postings.selectExpr("segment", "term", "inline(arrays_zip(docs, places))").join(index.documents.selectExpr("uid", "id"), F.expr("uid = shiftleft(segment, 20) | docs")).groupBy("term", "id").agg(F.sort_array(F.collect_list("places")).alias("places")).collect()}
    want = {}
    for i, t in docs:
        for k, w in enumerate(words(t)):
            want.setdefault((w, i), []).append(k)
    assert got == {k: sorted(v) for k, v in want.items()}  # every word of every text is stored
    for part in (items[:10], items[10:], []):
        b = spark.createDataFrame(part, "item_id long, text string")
        assert sorted(tuple(r) for r in contamination(None, b, index=index).collect()) == brute(docs, part)


def near(w, window, slop):
    """Starts of a window whose words all stand near their places, seen from its rarest word; by plain search."""
    count = {t: w.count(t) for t in window}
    order = sorted(range(len(window)), key=lambda k: (TOTAL[window[k]], k))
    first = order[0]
    return {i - first for i in range(len(w)) if count[window[first]] and w[i] == window[first] and all(any(0 <= j < len(w) and w[j] == window[k] for j in range(i - first + k - slop, i - first + k + slop + 1)) for k in order[1:])}


TOTAL = Counter()


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_proximity_against_brute_force(spark, slop):
    docs, items = made(9)
    rng = random.Random(slop)
    for i in range(40):  # passages with neighbours swapped
        cut = words(rng.choice(items[:20])[1])[:20]
        for k in range(0, len(cut) - 1, rng.randrange(2, 6)):
            cut[k], cut[k + 1] = cut[k + 1], cut[k]
        docs.append((2000 + i, " ".join(cut)))
    TOTAL.clear()
    TOTAL.update(w for _, t in docs for w in words(t))
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    matches, owners = phrase_matches(index, spark.createDataFrame(items, "item_id long, text string"), slop=slop)
    got = {(r.id, r.item, r.start) for r in matches.join(owners, "window_id").join(index.documents, "uid").collect()}
    want = set()
    for item, text in items:
        b = words(text)
        for k in range(max(1, len(b) - 12) if b else 0):
            for d, t in docs:
                want |= {(d, str(item), s) for s in near(words(t), b[k : k + 13], slop)}
    assert got == want and (not slop or any(d >= 2000 for d, _, _ in got))


def test_proximity(spark):
    item = " ".join(f"k{i}" for i in range(13))
    close = " ".join(f"k{i}" for i in (*range(6), 7, 6, *range(8, 13)))
    index = build_index(spark.createDataFrame([(0, item), (1, close), (2, " ".join(f"k{i} z" for i in range(13)))], "doc_id long, text string"))
    b = spark.createDataFrame([(0, item)], "item_id long, text string")
    for slop, want in ((0, {0}), (1, {0, 1})):
        matches, _ = phrase_matches(index, b, slop=slop)
        assert {r.id for r in matches.join(index.documents, "uid").collect()} == want


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in contamination(d, b).collect()] == [(1, 2, 0, 0)]
    assert contamination(d.where("false"), b).collect() == []
