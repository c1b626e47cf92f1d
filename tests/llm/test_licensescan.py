import random
import re
from collections import Counter

import pytest

from noticelake.llm.licensescan import FOLDER, NOTICES, least_size, least_votes, most_size, scan, telling_words, templates

SMALL = (*NOTICES, *(t for t in templates() if 0 < len(t[1]) < 2000))


def grams(text):
    words = re.findall("[a-z0-9]+", text.lower())
    return list(zip(words, words[1:]))


def brute(rows, texts, threshold=0.8):
    out = []
    for i, text in rows:
        a = grams(text or "")
        for k, (name, template) in enumerate(texts):
            b = grams(template)
            firsts = {g: b.index(g) for g in b}
            votes = Counter(p - firsts[g] for p, g in enumerate(a) if g in firsts)
            places = [o for o, v in votes.items() if v >= least_votes(len(b))]
            spans = {(max(0, o), min(len(a), e + len(b))) for o in places for e in places}
            scored = []
            for start, end in spans:
                if least_size(threshold, len(b)) <= end - start <= most_size(threshold, len(b)):
                    dice = 2 * (Counter(a[start:end]) & Counter(b)).total() / (end - start + len(b))
                    if dice >= threshold:
                        scored.append((-dice, start, end))
            for found in scored:
                if not any(other < found and other[1] < found[2] and found[1] < other[2] for other in scored):
                    out.append((str(i), found[1], found[2] - found[1], k, name, round(-found[0], 12)))
    return sorted(out)


def found(spark, rows, texts=None, **options):
    docs = spark.createDataFrame([(*r, 4, "u") for r in rows], "doc_id long, text string, place int, row string")
    return sorted((str(r.id), r.start, r.length, r.template, r.license, round(r.dice, 12)) for r in scan(docs, texts=texts, **options).collect())


def prose(rng, n):
    return " ".join(rng.choice(["license", "the", "under", "version", "word", "of", "permission", "is", "stone", "river"]) for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(80):
        words = rng.choice(SMALL)[1].split()
        for _ in range(rng.randrange(0, max(2, len(words) // 6))):
            words[rng.randrange(len(words))] = rng.choice(["", "changed", "the the"])
        middle = rng.choice([" ", "\n", "  ", "\n\n# "]).join(words)
        rows.append((i, rng.choice([f"{prose(rng, 30)}\n{middle}\n\n{prose(rng, 5)}", middle, "\n\n" + middle.upper() + "\n \n", f"x {middle} {prose(rng, 40)} {middle}"])))
    rows += [(100, None), (101, ""), (102, "word"), (103, "\n\n"), (None, SMALL[0][1]), (3, rows[3][1]), (104, (SMALL[0][1] + " ") * 10), (105, prose(rng, 100_000)), (106, SMALL[1][1].replace(" ", " · ")), (107, "of the of the")]
    for threshold in (0.5, 0.8, 1.0):
        got = found(spark, rows, SMALL, threshold=threshold)
        assert got == brute(rows, SMALL, threshold) and len({g[3] for g in got}) > 6


def test_every_licence_is_found_whole_inside_text_and_altered(spark):
    """Recall over the whole catalogue: as it is, in a long text, after a comment sign on each line, and with every 25th word changed."""
    rng, texts = random.Random(1), templates()
    rows, want = [], set()
    for k, (name, text) in enumerate(texts):
        words = text.split()
        commented = "\n".join(f"// {line}" for line in text.split("\n"))
        altered = " ".join("changed" if i % 25 == 12 else w for i, w in enumerate(words))
        for form, body in enumerate((text, f"{prose(rng, 400)} {' '.join(words)} {prose(rng, 400)}", commented, altered)):
            rows.append((10 * k + form, body))
            want.add((str(10 * k + form), name))
    got = {(g[0], g[4]) for g in found(spark, rows)}
    assert len(want & got) >= 0.97 * len(want)
    assert {w for w in want if not w[0].endswith("3")} <= got
    assert len({name for name, _ in texts}) >= 20 and all(f.stat().st_size for f in FOLDER.glob("*.txt"))


def test_recall_of_insertions_and_repeats(spark):
    """Words put into the middle, up to two fifths of the licence, in one place or several, and licences that a text holds more than once."""
    rng, texts = random.Random(6), [t for t in templates() if 100 < len(t[1].split()) < 1500]
    rows, want = [], Counter()
    for k, (name, text) in enumerate(texts):
        words = text.split()
        for j, (share, places) in enumerate(((0.2, 1), (0.3, 1), (0.4, 1), (0.2, 3), (0.3, 4))):
            body = list(words)
            for p in sorted((rng.randrange(len(words) // 10, len(words) * 9 // 10) for _ in range(places)), reverse=True):
                body[p:p] = [f"q{rng.randrange(10_000)}" for _ in range(int(share * len(words) / places))]
            rows.append((100 * k + j, f"{prose(rng, 50)} {' '.join(body)} {prose(rng, 50)}"))
            want[str(100 * k + j), name] = 1
        rows.append((100 * k + 50, f"{text}\n{text}"))
        rows.append((100 * k + 51, f"{text} {prose(rng, 200)} {text}\n\n{prose(rng, 20)} {text}"))
        want[str(100 * k + 50), name], want[str(100 * k + 51), name] = 2, 3
    got = Counter((g[0], g[4]) for g in found(spark, rows))
    met = sum(min(n, got[key]) for key, n in want.items())
    assert met >= 0.95 * want.total(), (met, want.total())
    assert all(got[key] >= n for key, n in want.items() if n > 1)


def test_a_text_of_many_copies(spark):
    text = SMALL[0][1]
    got = found(spark, [(1, "\n".join([text] * 3_000))], SMALL[:1])
    assert len(got) == 3_000 and {g[2] for g in got} == {len(grams(text))}


def test_clean_prose_gives_nothing(spark):
    rng = random.Random(4)
    assert found(spark, [(i, prose(rng, 300)) for i in range(40)]) == []


def test_telling_words_are_in_every_similar_stretch():
    rng = random.Random(2)
    for _, text in SMALL:
        told = telling_words(text, 0.8)
        words = re.findall("[a-z0-9]+", text.lower())
        b = Counter(zip(words, words[1:]))
        for _ in range(200):
            drop = set(rng.sample(sorted(set(words)), rng.randrange(1, len(set(words)))))
            left = ["x" if w in drop else w for w in words]
            a = Counter(zip(left, left[1:]))
            if 2 * (a & b).total() / (a.total() + b.total()) >= 0.8:
                assert told & set(left)
    assert least_size(0.8, 6) == 4 and least_size(1.0, 6) == 6 and most_size(0.8, 6) == 9 and most_size(1.0, 6) == 6
    assert [least_votes(n) for n in (1, 2, 5, 160)] == [1, 2, 2, 10]


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_scan(spark, rows):
    assert scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []
