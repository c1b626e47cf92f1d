"""Addresses by likeness, against every pair."""

import random

from noticelake.operators import addresses as A


def grams(text):
    padded = f" {text.strip().lower()} "
    return {padded[i : i + 3] for i in range(max(1, len(padded) - 2))}


def likeness(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def altered(rng, text):
    k = rng.randrange(len(text))
    return rng.choice([text[:k] + text[k + 1 :], text[:k] + "x" + text[k:], text.upper(), text])


def test_no_pair_is_missed(spark):
    rng = random.Random(7)
    right = [" ".join(rng.choice(["ul", "bul", "first", "second", "garden", "sea", "варна", "north"]) for _ in range(rng.randrange(1, 5))) for _ in range(80)] + ["a", "", " ", None]
    left = [altered(rng, t) if t else t for t in right for _ in range(2)] + [None]
    frame = lambda texts, c: spark.createDataFrame([(t,) for t in texts], f"{c} string")
    for threshold in (0.5, 0.7, 1.0):
        got = {(r.l, r.r): r.likeness for r in A.alike(frame(left, "l"), frame(right, "r"), "l", "r", threshold).collect()}
        want = {(a, b): likeness(a, b) for a in left for b in right if a is not None and b is not None and likeness(a, b) >= threshold - 1e-9}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert A.alike(frame([], "l"), frame(right, "r"), "l", "r").count() == 0


def test_geocoded_alike(spark):
    gazetteer = spark.createDataFrame([("first street north", 1.0, 2.0), ("second street north", 3.0, 4.0), ("first street nor", 5.0, 6.0)], "address string, lat double, lng double")
    rows = spark.createDataFrame([(1, "first street north"), (2, "Second streeet north"), (3, "elsewhere"), (4, None), (5, "second streeet  north")], "i int, address string")
    got = {r.i: (r.matched, r.lat) for r in A.geocoded_alike(rows, gazetteer).collect()}
    assert got == {1: ("first street north", 1.0), 2: ("second street north", 3.0), 3: (None, None), 4: (None, None), 5: ("second street north", 3.0)}
