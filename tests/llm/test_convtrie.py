"""The trie of conversations against a plain one."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from noticelake.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def plainly(rows, family=20, shared=4):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        rest = c % family if c >= 0 else -(-c % family)
        built[c] = own.get(c - rest, [])[:h] + v[h:]
    nodes, children = defaultdict(list), defaultdict(int)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members) - 1) * words
            leaves[p[:d]] += not children[p]
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def through(spark, rows, **options):
    return sorted(map(tuple, convtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=str)


def test_random_conversations(spark):
    """Null ids, turns, roles and texts, repeated rows, equal turns, negative ids, missing bases."""
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(-25, 60)]), rng.choice([None, 0, 1, 2, 2, 3]), rng.choice(["user", "assistant", None]), rng.choice(["x y", "x", None, "z", "", "a\x0bb"])) for _ in range(900)]
    assert through(spark, rows) == plainly(rows)
    assert through(spark, rows, family=7, most_shared=3) == plainly(rows, 7, 3)


def test_long_conversations_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "BLOCK", 8)
    monkeypatch.setattr(convtrie, "FAMILIES", 2)
    rng = random.Random(4)
    rows = []
    for c in range(120):
        stem = rng.choice([0, 0, 17, 30])
        rows += [(c, t, "u", f"s{t}" if t < stem else f"w {rng.randrange(2)}") for t in range(rng.choice([0, 1, 3, 20, 40, 60]))]
    rows += [(c, t, "u", "same") for c in range(200, 420) for t in range(3)]
    assert through(spark, rows) == plainly(rows)


def test_one_conversation_of_most_turns_and_equal_turns(spark):
    rows = [(5, None, "u", "again")] * 400 + [(5, 1, "u", f"t{k}") for k in range(200)] + [(25, 0, "u", "again"), (25, 1, "u", "a")]
    assert through(spark, rows) == plainly(rows)


def test_turnless_empty_and_extra_columns(spark):
    c = next(k for k in range(41, 60) if zlib.crc32(str(k).encode()) % 4 == 3)
    rows = [(c, 0, "u", "cut away")]
    assert through(spark, rows) == plainly(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert through(spark, []) == []
    named = spark.createDataFrame([(1, 0, "u", "x", 7, 7, 7)], "`conv.id` long, turn long, role string, text string, conv long, depth long, pa long")
    assert convtrie.prefix_trie(named, conv_col="conv.id").count() == len(plainly([(1, 0, "u", "x")]))


def test_families_that_do_not_fit_a_bit_each_are_refused(spark):
    with pytest.raises(ValueError, match="family"):
        through(spark, [], family=40)
