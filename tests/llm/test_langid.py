"""Language models against plain counts, and held-out accuracy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from noticelake.llm import langid
from noticelake.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def letters_of(text):
    """The plain stream of a text: lower-case letters, one separator behind each word."""
    out = []
    for char in text:
        if char.isalpha():
            out.append(char.lower()[0])
        elif out and out[-1] != "\0":
            out.append("\0")
    if out and out[-1] != "\0":
        out.append("\0")
    return out


def plain_windows(text):
    found = ["\0"] * 3 + letters_of(text)
    return [tuple(found[i - 3 : i + 1]) for i in range(3, len(found))]


def unpacked(gram):
    return tuple(chr(int(gram) >> 16 * k & 0xFFFF) for k in (3, 2, 1, 0))


TEXTS = ["", "a", "  Ab, cd!", "12 -- \n", "Ünïcode Straße ΣΑΣ", "x1y", "trailing  ", "пРИвет мир", "中文字", "it's"]


def test_windows():
    grams, owner = langid.windows(TEXTS)
    found = defaultdict(list)
    for g, o in zip(grams, owner, strict=True):
        found[o].append(unpacked(g))
    assert {k: plain_windows(t) for k, t in enumerate(TEXTS) if plain_windows(t)} == found
    far = langid.windows(["\U00010400b \U0001d7d9"])[0]  # a letter beyond 16 bits, and a digit
    assert len(far) == 3


def plain_model(texts, alphabet):
    """Probabilities by the textbook: tables of tuples, recursion over orders."""
    tables = {4: Counter(w for t in texts for w in plain_windows(t))}
    for n in (3, 2, 1):
        tables[n] = Counter(w[1:] for w in tables[n + 1])
    discount = {}
    for n, table in tables.items():
        once, twice = (sum(v == k for v in table.values()) for k in (1, 2))
        discount[n] = once / (once + 2 * twice) if once and twice else 0.5
    sums, followers = defaultdict(int), defaultdict(int)
    for n, table in tables.items():
        for w, times in table.items():
            sums[n, w[:-1]] += times
            followers[n, w[:-1]] += 1

    def p(w):
        n, lower = len(w), 1 / alphabet if len(w) == 1 else p(w[1:])
        total = sums.get((n, w[:-1]), 0)
        if not total:
            return lower
        return (max(tables[n].get(w, 0) - discount[n], 0) + discount[n] * followers[n, w[:-1]] * lower) / total

    return p


def test_probabilities_are_those_of_the_textbook():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aab c") for _ in range(200)) for _ in range(5)] + ["une phrase ici", "et là"]
    alphabet = len({c for t in texts for c in letters_of(t)}) + 1
    p = plain_model(texts, alphabet)
    grams, times = np.unique(langid.windows(texts)[0], return_counts=True)
    model = langid.kneser_ney(grams, times, alphabet)
    asked, _ = langid.windows([*texts, "cab zzz aéb", "phrase"])
    assert np.allclose(model.log_probability(asked), [math.log2(p(unpacked(g))) for g in asked])
    for keys in (*model.grams, *model.contexts):
        assert (keys[1:] > keys[:-1]).all()
    behind = [plain_windows("aab")[2][:3] + (c,) for c in {*"abc\0"} | {c for t in texts for c in letters_of(t)}]
    assert sum(p(w) for w in behind) < 1.0001


def made(n, words, rng):
    return " ".join("".join(rng.choice(words) for _ in range(rng.randrange(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def taught(spark):
    rng = random.Random(1)
    rows = [(k, "aa" if k % 2 else "bb", made(30, ("ka", "lo", "mi") if k % 2 else ("ste", "gro", "und"), rng)) for k in range(300)]
    rows += [(None, "aa", made(30, ("ka", "lo", "mi"), rng)), (5, None, "ste"), (6, "cc", None), (7, "aa", "")]
    return langid.identify(spark.createDataFrame(rows, "doc_id long, lang string, text string"))


def test_rejection_and_odd_texts(spark, taught):
    rng = random.Random(9)
    known = [(k, made(30, ("ka", "lo", "mi"), rng)) for k in range(50)]
    strange = [(100 + k, made(30, ("qx", "zyw", "vj"), rng)) for k in range(50)]
    odd = [(200, None), (201, ""), (202, "12 \n -"), (203, "ka"), (204, "kalomi " * 50_000), (None, "ste gro")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in known + strange + odd], "doc_id long, text string, lang int, score int")
    got = {r.id: r for r in langid.identified(docs, taught[1]).collect()}
    assert len(got) == 106 and all(got[i].lang_pred == "aa" for i, _ in known)
    assert sum(got[i].accepted for i, _ in known) >= 45 and not any(got[i].accepted for i, _ in strange)
    assert [got[i].lang_pred for i in (200, 201, 202, 203, 204, None)] == ["und", "und", "und", "aa", "aa", "bb"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[200].score == 0 and not got[202].accepted


def test_the_same_by_any_parts(spark, taught):
    found, model = taught
    assert model.languages == ["aa", "bb"]
    docs = spark.createDataFrame([(k, made(20, ("ka", "und", "x"), random.Random(k))) for k in range(200)], "doc_id long, text string")
    one, many = (sorted(map(tuple, langid.identified(d, model).collect())) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == many


def test_every_text_calibrates(spark):
    """Each text, whatever its id, is scored by models of the other parts, and all of them make the thresholds."""
    rng = random.Random(4)
    docs = [(k if k % 3 else None, "aa" if k % 2 else "bb", made(rng.randrange(1, 40), ("ka", "lo", "mi", "st") if k % 2 else ("st", "gro", "ka"), rng)) for k in range(400)]
    docs += [(7, "aa", ""), (8, "bb", "12")]
    rows = spark.createDataFrame(docs, "id long, lang string, text string")
    model = langid.fitted(rows)
    dealt = rows.selectExpr("*", "pmod(xxhash64(5, id, text), 4) as part").collect()
    alphabet = len({c for r in dealt for c in letters_of(r.text)} | {"\0"}) + 1
    gaps, own, sizes = [], defaultdict(list), defaultdict(list)
    for part in range(4):
        counts = [np.unique(langid.windows([r.text for r in dealt if r.lang == lang and r.part != part])[0], return_counts=True) for lang in model.languages]
        others = langid.Identifier(model.languages, [langid.kneser_ney(*c, alphabet) for c in counts])
        mine = [r for r in dealt if r.part == part]
        for r, bits, size in zip(mine, *others.entropies([r.text for r in mine]), strict=True):
            if size:
                k = model.languages.index(r.lang)
                own[k].append(bits[k])
                sizes[k].append(size)
                gaps.append((bits - bits[k]) * math.sqrt(size))
    assert [len(own[k]) for k in (0, 1)] == [200, 200]
    grid = np.exp2(np.arange(-6, 7))
    losses = [np.log(np.exp(np.clip(-g * np.array(gaps), -700, 700)).sum(axis=1)).mean() for g in grid]
    assert model.sharpness == grid[np.argmin(losses)]
    for k in (0, 1):
        assert model.usual[k] == pytest.approx(np.median(own[k]), abs=1e-8)
        beyond = np.quantile((own[k] - np.median(own[k])) * np.sqrt(sizes[k]), 0.995) + math.sqrt(20) * max(np.std(own[k]), 0.1)
        assert model.furthest[k] == pytest.approx(beyond, abs=1e-6)


def test_quantiles(spark):
    rng = random.Random(3)
    of = {"aa": [rng.randrange(-(10**12), 10**12) for _ in range(501)], "bb": [5], "cc": [-3] * 300 + [rng.randrange(-9, 10**9) for _ in range(100)], "dd": [-(10**15), 10**15]}
    rows = spark.createDataFrame([(lang, v) for lang, values in of.items() for v in values], "lang string, value long").repartition(5)
    for share in (0, 0.25, 0.5, 0.995, 1):
        assert langid.quantiles(rows, share) == pytest.approx({lang: np.quantile(np.array(v), share) for lang, v in of.items()}, rel=1e-12)
    assert langid.quantiles(rows.where("value = 5"), 0.5) == {"bb": 5} and langid.quantiles(rows.limit(0), 0.5) == {}


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, None, "a b"), (2, None, None)], "doc_id long, lang string, text string")
    found, model = langid.identify(docs)
    assert model.models == [] and [(r.lang_pred, r.score) for r in found.collect()] == [("und", 0.0)] * 2
    assert langid.identify(docs.limit(0))[0].count() == 0


def test_models_that_could_be_too_large_are_refused(spark):
    docs = spark.createDataFrame([(1, "aa", "some words here")], "doc_id long, lang string, text string")
    with pytest.raises(ValueError, match="bits"):
        langid.identify(docs, most_mb=0)


def test_few_places_still_tell(spark):
    """Windows that share a place are merged into the commonest."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(300)
    found, model = langid.identify(docs, bits=10)
    assert all(len(m.grams[3]) <= 1024 for m in model.models)
    got = found.join(docs.select("doc_id", "lang"), found.id == docs.doc_id)
    assert got.where("lang = lang_pred").count() > 0.95 * got.count()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op12_language_id"](spark, DATA).join(docs, "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
