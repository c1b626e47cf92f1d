import random

import pytest
import xxhash

from noticelake.llm import common, simhash
from noticelake.llm.simhash import fingerprint_texts, links, near_duplicates


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprints_match_a_plain_count():
    texts = ["", None, "  \t\n", "One", "one two", "A b C", "ÉA b c d", "x " * 500, "a b c d e", "a b c a b c d"]
    got = fingerprint_texts([t if t is None else t.encode() for t in texts])
    assert [int(x) for x in got] == [brute_fingerprint(t) for t in texts]


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('a b c') h").first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("max_bits", [1, 2, 3])
@pytest.mark.parametrize("crowded", [4096, 1, 0])
def test_links_lose_nothing(spark, crowded, max_bits):
    rng = random.Random(7)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(18):
            v = base
            for _ in range(rng.randrange(6)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values |= {0, 1, 2**63, 2**64 - 1}
    signed = sorted(v - 2**64 if v >> 63 else v for v in values)
    want = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= max_bits]
    got = [tuple(r) for r in links(spark.createDataFrame([(v,) for v in signed], "fp long"), max_bits, crowded).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= max_bits for a, b in got)
    assert components(signed, got) == components(signed, want)
    if crowded == 4096:
        assert {tuple(sorted(x)) for x in got} == set(want)


def test_groups_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(120)) for _ in range(6)]
    rows = [(i, b) for i, b in enumerate(base)]
    for i in range(40):
        words = rng.choice(base).split()
        words[rng.randrange(120)] = "new"
        rows.append((10 + i, " ".join(words)))
    rows += [(90, None), (91, ""), (92, " \n"), (93, base[0].upper()), (94, "short one"), (94, "short one"), (None, base[1])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component int")
    got = sorted((str(r.id), r.fingerprint, str(r.component_id)) for r in near_duplicates(docs).collect())
    prints = {brute_fingerprint(t) for _, t in rows}
    comp = components(sorted(prints), [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for i, t in rows:
        if i is not None:
            c = comp[brute_fingerprint(t)]
            least[c] = min(i, least.get(c, i))
    assert got == sorted((str(i), f"{brute_fingerprint(t):016x}", str(least[comp[brute_fingerprint(t)]])) for i, t in rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_nothing_is_sent_whole(spark, monkeypatch):
    """Exploded rows look as small as the file that they come from, so Spark would send all of them through the driver."""
    plans = []

    def kept(df, name, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, *args)

    write = common.written
    monkeypatch.setattr(simhash, "written", kept)
    monkeypatch.setattr(common, "written", kept)
    docs = spark.createDataFrame([(i, f"some words {i % 40} that are {i % 7} long enough") for i in range(200)], "doc_id long, text string")
    plans.append(near_duplicates(docs)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastExchange" in p]


def test_a_fingerprint_is_indexed_twenty_times(spark):
    fps = spark.createDataFrame([(7919 * i,) for i in range(100)], "fp long")
    assert simhash._index(fps, simhash._masks(simhash.BLOCKS[0], 3)).count() == 2_000  # 66 times before


def test_crowded_buckets_lose_nothing(spark):
    """Two thousand values that share 52 bits, so every first bucket of theirs is crowded."""
    rng = random.Random(5)
    values = sorted({(rng.getrandbits(12) << 26) | 0x3 << 60 for _ in range(3_000)})
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3}
    assert {tuple(r) for r in links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()} == want
